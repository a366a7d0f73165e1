"""Every query of the library with SQL of its own, held against DuckDB on the small tables."""

import duckdb
import pytest

from ballotbox import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


def rows(data, names, order):
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    data = got.collect()
    assert data
    if name in Q.ORACLE_SQL:
        want = duck.execute(Q.ORACLE_SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(data, got.columns, sorted(names)) == rows(want.fetchall(), names, sorted(names))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_a_small_table_of_images_is_dealt_out(spark, monkeypatch, tmp_path):
    """A table of one partition becomes many tasks, images of a size one after another in one of them, so filter weights are made once a size."""
    from ballotbox.plans.scanner import Scanner

    monkeypatch.setattr(Q, "IMAGES_A_TASK", 1000)
    spark.range(12000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt, scan = [], Scanner.scan

    def seen(self, images):
        dealt.extend(images.select("width").rdd.glom().map(lambda rows: [r.width for r in rows]).collect())
        return scan(self, images)

    monkeypatch.setattr(Scanner, "scan", seen)
    assert Q.QUERIES["b1_auto_scan"](spark, str(tmp_path)).filter("payload is not null").count() == 12000
    assert len(dealt) == 12 and sum(map(len, dealt)) == 12000 and max(map(len, dealt)) < 2000
    assert all(x == sorted(x) for x in dealt) and sum(len(set(x)) for x in dealt) == 6000


def test_filter_weights_are_kept_by_size():
    import numpy as np

    from ballotbox.sources import images

    images._taps.cache_clear()
    pixels = np.random.default_rng(5).integers(0, 256, (3, 2500, 3), dtype=np.uint8)
    first = images.shrunk(pixels, 2000, 2)
    assert (images.shrunk(pixels, 2000, 2) == first).all() and images._taps.cache_info().hits == 2
    weight = lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    across = np.zeros((3, 2000, 3))
    for i in range(2000):
        w = weight((np.arange(2500) + 0.5 - (i + 0.5) * 1.25) / 1.25)
        across[:, i] = np.einsum("hwc,w->hc", pixels, w / w.sum())
    across = np.clip(np.floor(across + 0.5), 0, 255)
    for y in range(2):
        w = weight((np.arange(3) + 0.5 - (y + 0.5) * 1.5) / 1.5)
        want = np.clip(np.floor(np.einsum("hwc,h->wc", across, w / w.sum()) + 0.5), 0, 255)
        assert np.abs(first[y] - want).max() <= 1
