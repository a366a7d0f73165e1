import struct
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ballotbox import errors
from ballotbox.plans import scanner as S
from ballotbox.sources import images as I


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this module


class Fixed:
    def __init__(self, name, found):
        self.name, self.found = name, found

    def detect_and_decode(self, content):
        if self.found is None:
            raise RuntimeError("broken")
        return self.found


BOX = {"x1": 50.0, "y1": 50.0, "x2": 150.0, "y2": 150.0, "symbology": "qr", "payload": "hello", "score": 0.9}


@pytest.fixture
def engines(monkeypatch):
    monkeypatch.setattr(S, "REGISTRY", {})
    S.register("e1", lambda: Fixed("e1", [BOX]))
    S.register("e2", lambda: Fixed("e2", [BOX]))
    S.register("broken", lambda: Fixed("broken", None))


def test_scan_isolates_failures_and_keeps_empty_images(spark, engines):
    images = spark.createDataFrame([(1, 200, 100, b"x"), (2, 10, 10, b"y")], "image_id bigint, width int, height int, content binary")
    out = S.Scanner(engines=("e1", "e2", "broken"), consensus=2).scan(images).orderBy("image_id").collect()
    assert [(r.n, r.per_engine) for r in out] == [(1, {"e1": 1, "e2": 1, "broken": 0})] * 2
    assert out[0].detections[0].engine == "consensus" and (out[0].width, out[0].height) == (200, 100)
    assert S.Scanner("broken").scan(images).first().n == 0


class Whole:
    """One box around the image that it gets, with the least and the largest value as payload."""

    name = "whole"

    def detect_and_decode(self, content):
        p = I.parse_ppm(content)
        h, w = p.shape[:2]
        return [{"x1": 0.0, "y1": 0.0, "x2": float(w), "y2": float(h), "symbology": "qr", "payload": f"{w}x{h} {p.min()} {p.max()}", "score": 0.9, "polygon": [{"x": 0.0, "y": 0.0}, {"x": float(w), "y": float(h)}]}]


def ppm(w, h):
    return b"P6 %d %d 255\n" % (w, h) + np.repeat(np.linspace(50, 99, w).astype(np.uint8)[None, :, None], 3, 2).repeat(h, 0).tobytes()


def test_auto_preprocess(spark, engines):
    S.register("whole", Whole)
    images = spark.createDataFrame([(1, 4001, 6, ppm(4001, 6)), (2, 20, 10, ppm(20, 10)), (3, 5, 5, b"\xff\xd8\xff")], "image_id bigint, width int, height int, content binary")
    off, auto = ({r.image_id: r for r in S.Scanner("whole", preprocess=p).scan(images).collect()} for p in ("off", "auto"))
    assert off[1].detections[0].payload == "4001x6 50 99"
    d = auto[1].detections[0]
    assert (d.payload, d.x1, round(d.x2, 6), d.y2) == ("2000x2 0 255", 0, 4001, 6)
    assert auto[2].detections[0].payload == "20x10 0 255" and auto[2].detections[0].x2 == 20
    assert auto[3].n == 0
    assert [(round(p.x, 6), p.y) for p in S.detect(images, "whole", preprocess="auto").filter("image_id = 1").first().polygon] == [(0, 0), (4001, 6)]


@pytest.mark.parametrize("content", [b"", b"\xff\xd8\xff", b"P6", b"P6 20 ", b"P6 20 10 255", b"P6 # no end"])
def test_ppm_cut_short(content):
    with pytest.raises(ValueError):
        I.parse_ppm(content)


def test_detect_errors(spark, engines):
    images = spark.createDataFrame([(1, b"x")], "image_id bigint, content binary")
    assert [tuple(r) for r in S.detect_errors(images, "broken").collect()] == [(1, "broken", "RuntimeError", "broken")]
    assert S.detect_errors(images, "e1").count() == 0
    assert S.detect_errors(images, "e1", preprocess="auto").first().type == "InvalidImage"


def test_anchor_rows_of_three_layouts():
    boxes, logits = np.ones((1, 300, 4)), np.zeros((1, 300, 9))
    assert I.anchor_rows([logits, boxes], "rtdetr_v2_r18vd")[0].tolist() == [1] * 4 + [0] * 9
    assert I.anchor_rows([np.zeros((1, 13, 8400))], "yolo11s").shape == (8400, 13)
    assert I.anchor_rows([np.zeros((1, 8400, 14))], None).shape == (8400, 14)


def test_shrunk():
    flat = np.full((40, 3000, 3), 77, np.uint8)
    assert (I.shrunk(flat, 2000, 26) == 77).all() and I.shrunk(flat, 2000, 26).shape == (26, 2000, 3)
    ramp = np.arange(200, dtype=np.uint8)[None, :, None].repeat(4, 0)
    assert np.abs(I.shrunk(ramp, 100, 4)[0, 5:95, 0] - (np.arange(5, 95) * 2 + 0.5)).max() <= 0.5


@pytest.mark.parametrize(("kwargs", "error"), [
    ({"engine": "e1", "engines": ("e1",)}, ValueError), ({"engine": "auto"}, ValueError), ({"engines": ()}, ValueError), ({"engines": "e1"}, TypeError), ({"engines": (1,)}, TypeError),
    ({"engines": ("e1", "e1")}, ValueError), ({"engines": ("nope",)}, ValueError), ({"engines": ("zxing",)}, errors.EngineMissing), ({"consensus": True}, TypeError), ({"consensus": 0}, ValueError),
    ({"consensus": 9}, ValueError), ({"engine": "e1", "consensus": 2}, ValueError), ({"preprocess": "x"}, ValueError),
])
def test_constructor(engines, kwargs, error):
    with pytest.raises(error):
        S.Scanner(**kwargs)


def test_introspection(engines):
    assert S.Scanner().engine_name == "consensus" and S.Scanner("e1").engine_name == "e1"
    assert issubclass(errors.EngineMissing, ImportError) and issubclass(errors.InvalidImage, ValueError)
    assert S.recommended_workers("consensus") == 3 and S.physical_cores() >= 1


def test_rescale(spark):
    det = spark.createDataFrame([(1, 100.0, 200.0, 300.0, 400.0)], "image_id bigint, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(1, 4000, 3000)], "image_id bigint, width int, height int")
    row = S.rescaled(det, images).first()
    assert (row.x1, row.y1, row.x2, row.y2) == (200, 400, 600, 800)


def test_formats_sizes_and_errors(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20)
    rows = [(1, png), (2, b"GIF89a" + struct.pack("<HH", 0, 5)), (3, b"junk"), (4, None), (5, b"\xff\xd8\xff\xe0"), (6, b"RIFF1234WEBPVP8 ")]
    out = {r.id: r for r in I.checked(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert (out[1].format, out[1].width, out[1].height, out[1].error) == ("png", 30, 20, None)
    assert out[2].error.message == "an image without pixels" and out[3].error and out[4].error
    assert out[5].format == "jpeg" and out[6].format == "webp"


def test_pixels():
    ppm = b"P6 # note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6])
    assert I.parse_ppm(ppm).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert I.bgr(I.parse_ppm(ppm)).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    red = np.zeros((567, 1234, 3), np.uint8)
    red[..., 0] = 255
    tensor, ratio = I.letterboxed(red)
    assert tensor.shape == (1, 3, 640, 640) and ratio == 640 / 1234 and tensor[0, :, 0, 0].tolist() == [1, 0, 0]
    assert I.autocontrast(np.array([[[10], [20]]], np.uint8)).ravel().tolist() == [0, 255]
    assert I.rgb(np.zeros((2, 2), np.uint8)).shape == (2, 2, 3)


def test_stream(spark, tmp_path):
    from ballotbox.queries import det
    from ballotbox.streaming.consensus import start

    d = det(spark, "/root/testdata/sf0.001").filter("image_id < 10")
    d.write.parquet(str(tmp_path / "in"))
    got = []
    start(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), lambda df, i: got.append(df.count()), 2, checkpoint=str(tmp_path / "ck")).awaitTermination()
    from ballotbox.operators.consensus import merge

    assert sum(got) == merge(d, 2).count()
    assert d.filter(F.col("engine") == "zxing").count() > 0
