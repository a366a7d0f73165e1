import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ballotbox.errors import EngineFailed, EngineMissing
from ballotbox.operators import adapters as A
from ballotbox.plans import native
from ballotbox.plans import scanner as S
from ballotbox.sources import images as I
from ballotbox.sources import models
from ballotbox.specimens import corpus, reader

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this module

def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def onnx_file(path, outputs, **metadata):
    """A model file whose outputs are constants, whatever image it gets."""

    def shape(dims):
        return b"".join(_field(1, _field(1, d)) for d in dims)

    def value(name, dims):
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape(dims))))

    graph = b"".join(_field(1, _field(1, f"c{k}") + _field(2, f"out{k}") + _field(4, "Identity")) for k in range(len(outputs))) + _field(2, "g")
    for k, a in enumerate(outputs):
        graph += _field(5, b"".join(_field(1, d) for d in a.shape) + _field(2, 1) + _field(8, f"c{k}") + _field(9, a.astype("<f4").tobytes()))
    graph += _field(11, value("images", (1, 3, 640, 640)))
    graph += b"".join(_field(12, value(f"out{k}", a.shape)) for k, a in enumerate(outputs))
    model = _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
    model += b"".join(_field(14, _field(1, f"tool_{k}") + _field(2, v)) for k, v in metadata.items())
    path.write_bytes(model)
    return str(path)


@pytest.fixture(scope="module")
def scene(spark):
    """One image of three codes, and the boxes around them in the model's pixels."""
    codes = [("https://example.org/x", "qr"), ("PART-9", "code_39"), ("012345678901", "ean_13")]
    parts = [corpus.draw(*c) for c in codes]
    (w, h), places = corpus.grid([(p.shape[1], p.shape[0]) for p in parts])
    image = corpus.composed(parts)
    ratio = min(640 / w, 640 / h)
    boxes = [((x + p.shape[1] / 2) * ratio, (y + p.shape[0] / 2) * ratio, p.shape[1] * ratio, p.shape[0] * ratio) for p, (x, y) in zip(parts, places, strict=True)]
    images = spark.createDataFrame([(1, w, h, corpus.to_png(image)), (2, 5, 5, b"no image")], "image_id bigint, width int, height int, content binary")
    return images, boxes


def yolox_rows(boxes, classes=(0, 6, 8), extra=()):
    rows = np.zeros((len(boxes) + len(extra), 19))
    for k, (b, c) in enumerate(zip([*boxes, *extra], [*classes, *[1] * len(extra)], strict=True)):
        rows[k, :4], rows[k, 4], rows[k, 5 + c] = b, 1, 0.9 - 0.01 * k
    return rows[None]


def plain():
    return reader.read


def test_whole_engine(spark, scene, tmp_path):
    images, boxes = scene
    model = onnx_file(tmp_path / "m.onnx", [yolox_rows(boxes, extra=[(10, 10, 16, 16)])], arch="yolox_s", num_classes="14")
    got = {r.det_ix: r for r in native.detections(images, model, "yolox_s", plain).collect()}
    assert {k: r.payload for k, r in got.items()} == {0: "https://example.org/x", 1: "PART-9", 2: "0123456789012", 3: None}
    assert got[0].extras["decoder"] == "zxing" and got[0].extras["decode_stage"] == "tight" and got[3].extras["decoder"] == "none"
    assert got[1].symbology == "code_39" and got[0].polygon[2].x == got[0].x2
    bare = native.detections(images, model, "yolox_s").collect()
    assert len(bare) == 4 and all(r.payload is None and r.engine == "native" for r in bare)


def test_fallbacks(spark, scene, tmp_path):
    images, boxes = scene
    small = [(b[0], b[1], 40, 40) for b in boxes]  # crops hold no whole code, the whole image does
    model = onnx_file(tmp_path / "m.onnx", [yolox_rows(small)], arch="yolox_s")
    got = {r.det_ix: r for r in native.detections(images, model, "yolox_s", plain).collect()}
    assert [got[k].payload for k in range(3)] == ["https://example.org/x", "PART-9", "0123456789012"]
    assert all(r.extras["decode_stage"] == "fallback" for r in got.values())

    def broken():
        def read(pixels):
            raise RuntimeError("broken")

        return read

    def second():
        return lambda pixels: b"\xff\xfeDM" if min(pixels.shape[:2]) >= 300 else None

    got = {r.det_ix: r for r in native.detections(images, model, "yolox_s", broken, second).collect()}
    assert got[0].payload == "��DM" and got[0].symbology == "data_matrix" and got[0].extras["detector_symbology"] == "QR" and got[0].extras["decoder"] == "libdmtx"
    assert got[1].payload is None and got[1].extras["decoder"] == "none"


def test_three_layouts_through_a_session(spark, scene, tmp_path):
    images, boxes = scene
    yolo11 = np.zeros((1, 18, 30))
    for k, b in enumerate(boxes):
        yolo11[0, :4, k], yolo11[0, 4 + k, k] = b, 0.9
    logits, places = np.full((1, 30, 14), -10.0), np.full((1, 30, 4), 0.5)
    for k, b in enumerate(boxes):
        logits[0, k, k], places[0, k] = 5, np.array(b) / 640
    for name, outputs in (("yolo11s", [yolo11]), ("rtdetr_v2_r18vd", [logits, places])):
        model = onnx_file(tmp_path / f"{name}.onnx", outputs, arch=name)
        found = native.detections(images, model, name, plain)
        assert sorted(r.payload for r in found.collect()) == ["0123456789012", "PART-9", "https://example.org/x"]
        assert I.infer(images, model).select("image_id").distinct().count() == 1  # the arch is the model's own
    rows = models.described(spark, {"a": str(tmp_path / "yolo11s.onnx"), "b": str(tmp_path / "rtdetr_v2_r18vd.onnx")}).orderBy("model").collect()
    assert [(r.arch, r.engine, r.num_classes) for r in rows] == [("yolo11s", "native-yolo11", 14), ("rtdetr_v2_r18vd", "native-rtdetr", 14)]


def test_preflight_and_metadata(tmp_path, caplog):
    good = onnx_file(tmp_path / "a.onnx", [np.zeros((1, 7, 19))], arch="yolox_s", num_classes="14")
    assert models.preflight(good) == 7 and models.metadata(good, whole=True) == {"tool_arch": "yolox_s", "tool_num_classes": "14"} and "model_version" in caplog.text
    with pytest.raises(EngineMissing, match="rtdetr"):
        models.preflight(good, "rtdetr")
    (tmp_path / "b.onnx").write_bytes(b"junk")
    with pytest.raises(EngineMissing):
        models.preflight(str(tmp_path / "b.onnx"))


def test_providers(monkeypatch):
    monkeypatch.setattr(models, "available_providers", lambda: ("CUDAExecutionProvider", models.CPU))
    assert models.providers() == ["CUDAExecutionProvider", models.CPU] and models.providers(["X"]) == ["X", models.CPU] and models.providers([models.CPU]) == [models.CPU]


def test_requested_formats():
    assert A.requested("zxing", None) is None and A.requested("zxing", ["qr", "gs1_databar"]) == ["QRCode", "DataBar"]
    assert A.requested("apple_vision", iter(["code_93"])) == ["VNBarcodeSymbologyCode93", "VNBarcodeSymbologyCode93i"]
    for decoder, formats, hint in (("zxing", ["other_1d"], "detect-only"), ("apple_vision", ["upc_a"], "leading zero"), ("apple_vision", ["maxicode"], "maxicode")):
        with pytest.raises(ValueError, match=hint):
            A.requested(decoder, formats)
    with pytest.raises(TypeError):
        A.requested("zxing", "qr")


def test_requested_formats_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "QRCode"), (2, "ITF")], "id int, raw_format string").write.parquet(str(tmp_path / "raw"))
    plan = A.restricted(spark.read.parquet(str(tmp_path / "raw")), "zxing", ["qr"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(raw_format), EqualTo(raw_format,QRCode)]" in plan or "In(raw_format" in plan


def test_wechat_lists_out_of_step(spark):
    raw = spark.createDataFrame([(1, ["a"], [])], "image_id bigint, texts array<string>, points array<array<struct<x:double,y:double>>>")
    with pytest.raises(Exception, match="as many texts"):
        A.wechat(raw).collect()


class Odd:
    name, warmed, closed = "odd", 0, 0

    def warmup(self):
        Odd.warmed += 1

    def detect_and_decode(self, content):
        raise EngineFailed("not today")


def test_lifecycle(spark, monkeypatch):
    with S.Scanner(Odd()) as scanner:
        scanner.warmup()
        assert Odd.warmed == 1 and scanner.engine_name == "odd"
        images = spark.createDataFrame([(1, 3, 2, b"x")], "image_id bigint, width int, height int, content binary")
        out = scanner.scan(images).first()
        assert out.n == 0 and out.errors["odd"].type == "EngineFailed" and out.errors["odd"].message == "not today" and out.raw == {"odd": []} and out.timings_ms["engine"] >= 0
        assert len(scanner._held) == 1
    scanner.close()
    assert scanner._held == [] and scanner.scan(images).first().n == 0
    scanner.close()
    monkeypatch.setattr(S, "REGISTRY", {"wechat": Odd, "mine": Odd})
    assert S.auto_resolve() == "wechat"
    monkeypatch.setattr(S, "REGISTRY", {})
    with pytest.raises(EngineMissing):
        S.auto_resolve()
    with pytest.raises(TypeError):
        S.Scanner(object())
    with pytest.raises(NotImplementedError):
        S.Scanner(model="x.onnx")
    with pytest.raises(ValueError):
        S.Scanner(engines={"a": Odd, "b": Odd}, iou_threshold=1.5)
    assert [S.recommended_workers("apple_vision", n) <= m for n, m in (("ultra", 16), ("standard", 8))] == [True, True] and S.recommended_workers("apple_vision") == 2


def test_batch(spark):
    png = corpus.to_png(corpus.draw("batch", "qr"))
    scanner = S.Scanner(reader.Plain(), preprocess="auto")
    rows = scanner.scan_batch(spark, [png, b"junk", np.full((9, 9), 255, np.uint8), os.devnull]).collect()
    assert [(r.input_ix, r.n, r.error is None) for r in rows] == [(0, 1, True), (1, None, False), (2, 0, True), (3, None, False)]
    assert rows[0].detections[0].payload == "batch" and rows[0].detections[0].polygon and rows[0].detections[0].voted_by == ["plain"] and set(rows[0].timings_ms) == {"engine", "preprocess"}
    with pytest.raises(Exception, match="known format"):
        scanner.scan_batch(spark, [png, b"junk"], on_error="raise").collect()
    with pytest.raises(ValueError):
        scanner.scan_batch(spark, [png], on_error="ignore")


def test_result_lines(spark, tmp_path):
    images = spark.createDataFrame([(1, 1, 1, corpus.to_png(corpus.draw("line", "qr")))], "image_id bigint, width int, height int, content binary")
    results = S.Scanner(reader.Plain()).scan(images)
    I.write_results(results, str(tmp_path / "out"), "text")
    assert spark.read.text(str(tmp_path / "out")).first().value.startswith("qr 1.000 [40.0, 40.0, ")
    I.write_results(results.drop("timings_ms"), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).select(F.col("detections")[0]["payload"]).first()[0] == "line"


def test_hints_features_and_shapes(spark):
    assert S.hints(reader.Plain()) == {"native_format": "rgb", "thread_safety": "shared"} and S.hints(Odd())["native_format"] == "any"
    told = models.features(spark)
    assert "png" in told["python_formats"] and "jpeg" in told["jvm_formats"] and models.CPU in told["providers"] and told["onnxruntime"]
    for outputs, arch in (([np.zeros((8400, 19))], "yolox_s"), ([np.zeros((2, 8400, 19))], "yolox_s"), ([np.zeros((1, 300, 14))], "rtdetr"), ([np.zeros((1, 300, 14)), np.zeros((1, 200, 4))], "rtdetr")):
        with pytest.raises(ValueError):
            I.anchor_rows(outputs, arch)


def test_sampled_files(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.png").write_bytes(corpus.to_png(np.zeros((2, 3), np.uint8)))
    files = I.read_files(spark, str(tmp_path), "*.png")
    some = [r.path for r in I.sampled(files, 4, seed=1).collect()]
    assert len(set(some)) == 4 and some == [r.path for r in I.sampled(files, 4, seed=1).collect()]
    assert I.sampled(files, 0).count() == 9 and {(r.width, r.height, r.error) for r in files.collect()} == {(3, 2, None)}


def test_detailed_consensus(spark):
    from ballotbox.operators import consensus as C
    from ballotbox.schema import DETECTIONS

    one = spark.createDataFrame([(1, "x", 0, 0, 0.0, 0.0, 9.0, 9.0, 0.9, "qr", "p", None, {})], DETECTIONS)
    merged, raw = C.run_detailed({"a": one, "b": one}, 2)
    assert merged.first().voted_by == ["a", "b"] and sorted(r.engine for r in raw.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        C.run({"a": one}, 2)
