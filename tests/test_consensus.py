"""Unit vectors of overlap, clustering and merging, and a literal transcription of the greedy loop on random boxes."""

import random

import pytest
from pyspark.sql import functions as F

from ballotbox.functions import geometry as G
from ballotbox.functions.fold import clustered
from ballotbox.operators import consensus as C

COLUMNS = "image_id bigint, engine string, engine_rank int, det_ix int, x1 double, y1 double, x2 double, y2 double, score double, symbology string, payload string"


def frame(spark, rows):
    """rows: (engine, box, symbology, score, payload) of one image."""
    names = sorted({r[0] for r in rows})
    return spark.createDataFrame([(1, e, names.index(e), i, *map(float, b), s, y, p) for i, (e, b, y, s, p) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize(("a", "b", "want"), [
    ((10, 20, 110, 220), (10, 20, 110, 220), 1.0), ((0, 0, 10, 10), (100, 100, 110, 110), 0.0), ((0, 0, 100, 100), (25, 25, 75, 75), 0.25),
    ((0, 0, 10, 10), (5, 0, 15, 10), 50 / 150), ((0, 0, 0, 0), (1, 1, 5, 5), 0.0),
])
def test_iou(spark, a, b, want):
    row = spark.createDataFrame([(*map(float, a), *map(float, b))], ", ".join(f"{c}{s} double" for s in "ab" for c in G.BOX))
    assert row.select(G.iou(G.columns("a"), G.columns("b"))).first()[0] == pytest.approx(want)


def plain_iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = area(a) + area(b) - w * h
    return w * h / union if w * h and union > 0 else 0.0


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5])
def test_clusters_equal_the_greedy_loop(spark, threshold):
    rng, rows = random.Random(5), []
    for image in range(40):
        for ix in range(10):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            rows.append((image, f"e{ix % 3}", ix % 3, ix, float(x), float(y), float(x + rng.choice([0, 20, 30])), float(y + 25), rng.choice([0.5, 0.9, 1.0]), "qr", None))
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.image_id, r.det_ix): (r.pos, r.seed) for r in clustered(df.repartition(7), threshold).collect()}
    for image in range(40):
        own = sorted((r for r in rows if r[0] == image), key=lambda r: (-r[8], r[2], r[3]))
        owner = [None] * len(own)
        for i in range(len(own)):
            if owner[i] is None:
                owner[i] = i
                for j in range(i + 1, len(own)):
                    if owner[j] is None and plain_iou(own[i][4:8], own[j][4:8]) >= threshold:
                        owner[j] = i
        assert {(image, r[3]): (i, owner[i]) for i, r in enumerate(own)} == {k: v for k, v in got.items() if k[0] == image}


BOX = (50, 50, 150, 150)


@pytest.mark.parametrize(("rows", "field", "want"), [
    ([("a", BOX, "qr", 0.9, "foo"), ("b", BOX, "qr", 0.8, "foo"), ("c", BOX, "qr", 0.7, "bar")], "payload", "foo"),
    ([("a", BOX, "qr", 0.9, None), ("b", BOX, "qr", 0.8, None)], "payload", None),
    ([("a", BOX, "qr", 0.9, None), ("b", BOX, "qr", 0.7, "X"), ("c", BOX, "qr", 0.65, "Y")], "payload", "X"),
    ([("a", BOX, "micro_qr", 0.9, "x"), ("b", BOX, "qr", 0.7, "x")], "symbology", "micro_qr"),
    ([("zxing", BOX, "qr", 0.9, "x"), ("apple_vision", BOX, "qr", 0.9, "x")], "voted_by", ["apple_vision", "zxing"]),
    ([("a", BOX, "qr", 0.9, "x"), ("b", BOX, "qr", 0.7, "x")], "score", 0.8),
    ([("a", BOX, "qr", 0.9, "x"), ("a", BOX, "qr", 0.7, "x")], "vote_count", 1),
    ([("a", BOX, "qr", 0.9, "x")], "engine", "consensus"),
])
def test_merge_rules(spark, rows, field, want):
    out = C.merge(frame(spark, rows), 1).collect()
    assert len(out) == 1
    assert out[0][field] == (pytest.approx(want) if isinstance(want, float) else want)


def test_median_box_and_thresholds(spark):
    rows = [("a", (100, 200, 300, 400), "qr", 0.9, "x"), ("b", (110, 210, 310, 410), "qr", 0.8, "x"), ("c", (120, 200, 320, 400), "qr", 0.7, "x")]
    merged = C.merge(frame(spark, rows), 3).first()
    assert (merged.x1, merged.y1, merged.x2, merged.y2) == (110, 200, 310, 400)
    two = [("a", (10, 10, 60, 60), "qr", 0.9, "A"), ("b", (10, 10, 60, 60), "qr", 0.9, "A"), ("a", (140, 140, 190, 190), "qr", 0.9, "B")]
    assert [r.payload for r in C.merge(frame(spark, two), 2).collect()] == ["A"]
    assert sorted(r.payload for r in C.merge(frame(spark, two), 1).collect()) == ["A", "B"]


def test_chain_follows_seed_order(spark):
    # A and B overlap, B and C overlap, A and C don't: the best score decides
    chain = lambda s: [("a", (0, 0, 10, 10), "qr", s[0], "a"), ("b", (3, 0, 13, 10), "qr", s[1], "b"), ("c", (6, 0, 16, 10), "qr", s[2], "c")]
    assert C.merge(frame(spark, chain([0.5, 0.9, 0.5])), 1).count() == 1
    assert C.merge(frame(spark, chain([0.9, 0.5, 0.4])), 1).count() == 2


def test_one_shuffle(spark):
    rows = [("a", BOX, "qr", 0.9, "x"), ("b", BOX, "qr", 0.7, "x")]
    plan = C.cluster_votes(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("engines", "votes", "iou"), [([], 1, 0.5), (["a"], 2, 0.5), (["a"], 0, 0.5), (["a"], True, 0.5), (["a"], 1, 1.5)])
def test_arguments(engines, votes, iou):
    with pytest.raises(ValueError):
        C.check_arguments(engines, votes, iou)


def test_empty_images_and_engines(spark):
    d = frame(spark, [("a", BOX, "qr", 0.9, "x")])
    images = spark.createDataFrame([(1,), (2,)], "image_id bigint")
    got = {(r.image_id, r.engine): r.n for r in C.per_engine(d, ["a", "b"], images).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 0, (2, "b"): 0}
    assert C.merge(d.filter(F.lit(False)), 1).count() == 0
