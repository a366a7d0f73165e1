import pytest
from pyspark.sql import functions as F

from ballotbox import schema
from ballotbox.operators import decode as D
from ballotbox.operators import postprocess as P

ANCHORS = "image_id bigint, anchor_ix bigint, feat array<double>, ratio double, width int, height int"


def anchors(spark, feats, ratio=1.0, w=640, h=640):
    return spark.createDataFrame([(1, i, [float(x) for x in f], ratio, w, h) for i, f in enumerate(feats)], ANCHORS)


def classes(n, **at):
    return [at.get(f"c{i}", 0.0) for i in range(n)]


def test_rtdetr(spark):
    rows = [[0.25, 0.5, 0.1, 0.1, *[5.0 if i == 0 else -10 for i in range(14)]], [0.5, 0.5, 0.5, 0.5, *[3.0 if i == 5 else -10 for i in range(14)]], [0.5, 0.5, 0.5, 0.5, *[-2.0 if i == 0 else -10 for i in range(14)]]]
    out = P.detections(anchors(spark, rows), "rtdetr_r50").orderBy(F.desc("score")).collect()
    assert [r.class_id for r in out] == [0, 5]
    assert out[0].score == pytest.approx(0.9933, abs=1e-4)
    assert (out[0].x1, out[0].y1, out[0].x2, out[0].y2) == pytest.approx((128, 288, 192, 352))


def test_yolo11(spark):
    rows = [[320, 320, 100, 100, *classes(14, c0=0.95)], [160, 160, 80, 80, *classes(14, c5=0.75)], [300, 300, 9, 9, *classes(14, c2=0.10)]]
    out = P.detections(anchors(spark, rows), "yolo11s", 0.5).orderBy(F.desc("score")).collect()
    assert len(out) == 2
    assert (out[0].x1, out[0].y1, out[0].x2, out[0].y2) == (270, 270, 370, 370)


def test_yolox_suppresses_by_class_and_drops_flat_boxes(spark):
    rows = [[100, 100, 50, 50, 1, *classes(14, c0=0.9)], [102, 100, 50, 50, 1, *classes(14, c0=0.8)], [102, 100, 50, 50, 1, *classes(14, c3=0.8)], [900, 100, 50, 50, 1, *classes(14, c0=0.9)]]
    out = P.detections(anchors(spark, rows), "yolox_s").collect()
    assert sorted(r.anchor_ix for r in out) == [0, 2]


def test_too_few_features(spark):
    with pytest.raises(Exception, match="too few features"):
        P.scored(anchors(spark, [[1, 2, 3, 4, 5]]), "yolox_s").collect()


@pytest.mark.parametrize(("meta", "features", "layout", "want"), [({"tool_num_classes": "14"}, 99, "yolox", 14), ({}, 19, "yolox", 14), ({}, 14, "rtdetr", 10), ({}, None, "yolox", 9), ({"tool_num_classes": "x"}, 14, "yolox", 9)])
def test_num_classes(meta, features, layout, want):
    assert P.num_classes(meta, features, layout) == want


def test_class_tables(spark):
    assert schema.symbology_of(0) == "qr" and schema.symbology_of(16) == "maxicode"
    with pytest.raises(ValueError):
        schema.symbology_of(17)
    rows = spark.createDataFrame([(7,), (99,), (-1,)], "class_id int")
    assert {r.class_id: r.symbology for r in P.with_symbology(rows, 9).collect()} == {7: "other_1d", 99: "other_1d", -1: "other_1d"}
    assert {r.class_id: r.symbology for r in P.with_symbology(rows, 14).collect()}[7] == "code_93"


def test_engine_names():
    assert [P.engine_name(a) for a in ("yolox_s", "rtdetr_x", "yolo11s", "other")] == ["native", "native-rtdetr", "native-yolo11", "native-other"]


@pytest.mark.parametrize(("detector", "decoder", "decoded", "want"), [("qr", "zxing", "data_matrix", "data_matrix"), ("qr", "libdmtx", None, "data_matrix"), ("qr", "none", None, "qr")])
def test_reconciliation(spark, detector, decoder, decoded, want):
    row = spark.createDataFrame([(decoder, decoded, detector)], "a string, b string, c string").select(D.reconciled(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == want


def test_crops(spark):
    box = spark.createDataFrame([(1, 205.0, 205.0, 206.0, 206.0, 200, 200), (2, 10.0, 10.0, 10.0, 10.0, 200, 200), (3, 50.0, 50.0, 150.0, 150.0, 200, 200)], "det_ix int, x1 double, y1 double, x2 double, y2 double, width int, height int")
    ladder = D.crop_ladder(box).filter("det_ix = 3").orderBy("stage_ix").collect()
    assert [(r.stage, r.cx1, r.cx2) for r in ladder] == [("tight", 45, 155), ("medium", 35, 165), ("large", 20, 180)]
    assert D.crop_ladder(box).filter("det_ix = 2").count() == 0
    assert D.fallback_crop(box).filter("det_ix = 1").count() == 0
