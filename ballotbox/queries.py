"""The library's operators bound to the driver's tables, each with the SQL that says the same.

The tables hold no images: detections are derived from ``events`` with integer arithmetic only, model output from ``embeddings``,
image sizes from ``part``. Queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.fold import suppressed
from .operators import adapters as A
from .operators import consensus as C
from .operators import decode as D
from .operators import metrics as M
from .operators import postprocess as P
from .plans.scanner import Scanner, rescaled, table_engine
from .schema import ENGINES, SYMBOLOGIES, dim_decoder_format, dim_symbology, requestable
from .sources.pixels import decode
from .specimens import corpus
from .specimens.reader import Plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# --- derived tables -------------------------------------------------------------------------------------------------

ENGINE_CASE = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENGINES)) + " END"
_DET = f"""
  SELECT event_id // 12 AS image_id, {ENGINE_CASE} AS engine, CAST(event_id % 4 AS INT) AS engine_rank, CAST(event_id AS INT) AS det_ix,
    CAST(100 * ((event_id // 4) % 3) + (user_id * 7) % 23 AS DOUBLE) AS x1, CAST(50 * ((event_id // 12) % 3) + (user_id * 5) % 19 AS DOUBLE) AS y1,
    CAST(100 * ((event_id // 4) % 3) + (user_id * 7) % 23 + 60 + user_id % 9 AS DOUBLE) AS x2, CAST(50 * ((event_id // 12) % 3) + (user_id * 5) % 19 + 60 + (user_id * 3) % 7 AS DOUBLE) AS y2,
    (250 + (event_id * 37) % 751) / 1000.0::DOUBLE AS score, CASE WHEN event_type <> 'error' THEN 'P' || CAST(user_id % 3 AS VARCHAR) END AS payload,
    CASE event_type WHEN 'purchase' THEN 'code_128' WHEN 'signup' THEN 'data_matrix' WHEN 'error' THEN 'ean_13' ELSE 'qr' END AS symbology,
    value AS ms, user_id, CAST(400 + (event_id // 12 * 37) % 2700 AS INT) AS width, CAST(300 + (event_id // 12 * 53) % 2100 AS INT) AS height
  FROM events"""
DET = f"WITH det AS ({_DET})"


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    image, slot, u = F.expr("event_id div 12"), F.expr("event_id div 4") % 3, F.col("user_id")
    x1, y1 = 100 * slot + (u * 7) % 23, 50 * (image % 3) + (u * 5) % 19
    kind = F.col("event_type")
    return e.select(
        image.alias("image_id"), F.element_at(F.array(*[F.lit(x) for x in ENGINES]), (F.col("event_id") % 4 + 1).cast("int")).alias("engine"),
        (F.col("event_id") % 4).cast("int").alias("engine_rank"), F.col("event_id").cast("int").alias("det_ix"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 60 + u % 9).cast("double").alias("x2"), (y1 + 60 + (u * 3) % 7).cast("double").alias("y2"),
        ((250 + (F.col("event_id") * 37) % 751) / F.lit(1000.0)).alias("score"), F.when(kind != "error", F.concat(F.lit("P"), (u % 3).cast("string"))).alias("payload"),
        F.when(kind == "purchase", "code_128").when(kind == "signup", "data_matrix").when(kind == "error", "ean_13").otherwise("qr").alias("symbology"),
        F.col("value").alias("ms"), u, (400 + image * 37 % 2700).cast("int").alias("width"), (300 + image * 53 % 2100).cast("int").alias("height"),
    )


def iou_sql(a: str, b: str, clamp: bool = True) -> str:
    inter = f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    area = lambda x: f"(greatest(0.0, {x}.x2 - {x}.x1) * greatest(0.0, {x}.y2 - {x}.y1))" if clamp else f"(({x}.x2 - {x}.x1) * ({x}.y2 - {x}.y1))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(CASE WHEN {inter} <= 0 OR {union} <= 0 THEN 0.0 ELSE {inter} / {union} END)"


def folded(source: str, t: float, keys: str = "image_id", order: str = "engine_rank, det_ix", clamp: bool = True) -> str:
    """SQL for clustered rows ``cl`` of a relation: the greedy loop as a list fold."""
    box = "{'ix': det_ix, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
    return f"""g AS (SELECT {keys}, list({box} ORDER BY score DESC, {order}) AS b FROM {source} GROUP BY {keys}),
      s AS (SELECT {keys}, list_reduce(b, lambda acc, c: CASE WHEN len(list_filter(acc.k, lambda o: {iou_sql("o", "c", clamp)} >= {t})) > 0 THEN acc ELSE {{'k': list_append(acc.k, c)}} END, {{'k': b[1:0]}}).k AS seeds FROM g),
      cl AS (SELECT d.*, list_filter(s.seeds, lambda o: o.ix = d.det_ix OR {iou_sql("o", "d", clamp)} >= {t})[1].ix AS seed FROM {source} d JOIN s USING ({keys})),
      n AS (SELECT *, row_number() OVER (PARTITION BY image_id, seed ORDER BY score DESC, engine_rank, det_ix) AS pos FROM cl)"""


MERGED = """v AS (SELECT *, count(*) OVER (PARTITION BY image_id, seed, symbology) AS sc, count(payload) OVER (PARTITION BY image_id, seed, payload) AS pc FROM n),
  merged AS (SELECT image_id, seed, median(x1) AS x1, median(y1) AS y1, median(x2) AS x2, median(y2) AS y2, avg(score) AS score,
    first(symbology ORDER BY sc DESC, score DESC, symbology DESC) AS symbology,
    first(payload ORDER BY pc DESC, score DESC, pos) FILTER (payload IS NOT NULL) AS payload,
    array_to_string(list_sort(list(DISTINCT engine)), ',') AS voted_by, coalesce(array_to_string(list_sort(list(DISTINCT payload) FILTER (payload IS NOT NULL)), ','), '') AS agreed_payloads,
    CAST(count(DISTINCT engine) AS INT) AS vote_count, CAST(count(*) AS INT) AS source_count FROM v GROUP BY image_id, seed)"""
_MERGED_COLUMNS = "image_id, x1, y1, x2, y2, round(score, 6) AS score, symbology, payload, voted_by, agreed_payloads, vote_count, source_count, 'consensus' AS engine"


def _flat(merged: DataFrame) -> DataFrame:
    return merged.select("image_id", "x1", "y1", "x2", "y2", F.round("score", 6).alias("score"), "symbology", "payload", F.array_join("voted_by", ",").alias("voted_by"), F.array_join("agreed_payloads", ",").alias("agreed_payloads"), "vote_count", "source_count", "engine")


# --- consensus ------------------------------------------------------------------------------------------------------


@query(f"{DET}, {folded('det', 0.5)}, c AS (SELECT image_id, seed, count(DISTINCT engine) AS v, count(*) AS k FROM cl GROUP BY 1, 2) SELECT CAST(v AS INT) AS vote_count, count(*) AS clusters, CAST(sum(k) AS BIGINT) AS detections FROM c GROUP BY 1")
def h4_cluster_votes(spark, sf_dir):
    return M.vote_histogram(det(spark, sf_dir))


def _consensus(votes: int, engines: tuple[str, ...] = ENGINES, threshold: float = 0.5) -> Query:
    return lambda spark, sf_dir: _flat(C.merge(det(spark, sf_dir).filter(F.col("engine").isin(*engines)), votes, threshold))


for _n, _v, _e, _t in (("h_consensus_union", 1, ENGINES, 0.5), ("h_consensus_2", 2, ENGINES, 0.5), ("h_consensus_3", 3, ENGINES, 0.5), ("h18_unanimous", 4, ENGINES, 0.5), ("h_consensus_subset", 2, ("zxing", "wechat"), 0.5), ("h_consensus_loose", 2, ENGINES, 0.0), ("h_consensus_strict", 2, ENGINES, 0.9)):
    _src = "det" if _e == ENGINES else "(SELECT * FROM det WHERE engine IN (" + ", ".join(f"'{x}'" for x in _e) + "))"
    query(f"{DET}, src AS (SELECT * FROM {_src}), {folded('src', _t)}, {MERGED} SELECT {_MERGED_COLUMNS} FROM merged WHERE vote_count >= {_v}", _n)(_consensus(_v, _e, _t))


@query(f"{DET}, i AS (SELECT DISTINCT image_id FROM det), e AS (SELECT unnest(['{"', '".join((*ENGINES, 'none'))}']) AS engine) SELECT i.image_id, e.engine, count(det.det_ix) AS n FROM i CROSS JOIN e LEFT JOIN det ON det.image_id = i.image_id AND det.engine = e.engine GROUP BY 1, 2")
def h2b_per_engine_counts(spark, sf_dir):
    d = det(spark, sf_dir)
    return C.per_engine(d, [*ENGINES, "none"], d.select("image_id").distinct())


@query(f"{DET} SELECT a.image_id, a.det_ix AS a_ix, b.det_ix AS b_ix, round({iou_sql('a', 'b')}, 6) AS iou FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_ix < b.det_ix WHERE {iou_sql('a', 'b')} > 0")
def h5_iou_pairs(spark, sf_dir):
    d = det(spark, sf_dir).select("image_id", "det_ix", *G.BOX)
    a, b = (d.select("image_id", F.col("det_ix").alias(f"{p}_ix"), *[F.col(c).alias(c + p) for c in G.BOX]) for p in "ab")
    met = a.join(b, "image_id").filter("a_ix < b_ix").withColumn("iou", G.iou(G.columns("a"), G.columns("b")))
    return met.filter("iou > 0").select("image_id", "a_ix", "b_ix", F.round("iou", 6).alias("iou"))


@query(f"{DET}, {folded('det', 0.5)}, p AS (SELECT image_id, seed, min(pos) AS pos FROM n GROUP BY 1, 2 HAVING count(DISTINCT engine) >= 2) SELECT image_id, n.x1 AS first_x, n.y1 AS first_y, n.x2 AS third_x, n.y2 AS third_y FROM n JOIN p USING (image_id, seed, pos)")
def h11_polygon(spark, sf_dir):
    """The polygon of the best member."""
    merged = C.merge(det(spark, sf_dir).withColumn("polygon", G.corners(G.columns())), 2)
    a, c = F.col("polygon")[0], F.col("polygon")[2]
    return merged.select("image_id", a["x"].alias("first_x"), a["y"].alias("first_y"), c["x"].alias("third_x"), c["y"].alias("third_y"))


@query(f"{DET}, {folded('det', 0.5)}, {MERGED} SELECT image_id, symbology, payload, round(merged.score, 6) AS score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY merged.score DESC, fs.score DESC, fs.engine_rank, seed) - 1 AS INT) AS code_ix FROM merged JOIN (SELECT image_id AS ii, det_ix AS seed2, score, engine_rank FROM det) fs ON fs.ii = image_id AND seed2 = seed WHERE vote_count >= 2")
def h16_output_order(spark, sf_dir):
    return C.merge(det(spark, sf_dir), 2).select("image_id", "symbology", "payload", F.round("score", 6).alias("score"), "code_ix")


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose content is their detections as JSON, for engines that give back what was recorded."""
    d = det(spark, sf_dir)
    each = d.groupBy("image_id", "width", "height", "engine").agg(F.array_sort(F.collect_list(F.struct("det_ix", *G.BOX, "score", "symbology", "payload"))).alias("found"))
    found = F.transform("found", lambda x: x.withField("extras", F.create_map(F.lit("ix"), x["det_ix"].cast("string"))).dropFields("det_ix"))
    whole = each.groupBy("image_id", "width", "height").agg(F.map_from_entries(F.collect_list(F.struct("engine", found.alias("found")))).alias("all"))
    return whole.select("image_id", "width", "height", F.encode(F.to_json("all"), "UTF-8").alias("content"))


def recorders(*names: str) -> dict:
    return {e: (lambda e=e: table_engine(e)) for e in names}


@query(f"{DET} SELECT image_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CAST(count(*) FILTER (engine = 'zxing') AS INT) AS n, coalesce(array_to_string(list(det_ix::VARCHAR ORDER BY score DESC, det_ix) FILTER (engine = 'zxing'), ','), '') AS order_ FROM det GROUP BY ALL")
def i_scan_single_engine(spark, sf_dir):
    with Scanner(engines=recorders("zxing")) as scanner:
        out = scanner.scan(recorded(spark, sf_dir))
    order = F.transform("detections", lambda d: d["extras"]["ix"])
    return out.select("image_id", "width", "height", "n", F.array_join(order, ",").alias("order_"))


@query(f"{DET}, {folded('det', 0.5)}, {MERGED}, i AS (SELECT DISTINCT image_id, width, height FROM det), m AS (SELECT image_id, count(*) AS n FROM merged WHERE vote_count >= 3 GROUP BY 1), {', '.join(f'e{k} AS (SELECT image_id, count(*) AS n FROM det WHERE engine_rank = {k} GROUP BY 1)' for k in range(4))} SELECT i.*, CAST(coalesce(m.n, 0) AS INT) AS n, {', '.join(f'CAST(coalesce(e{k}.n, 0) AS INT) AS {e}' for k, e in enumerate(ENGINES))} FROM i LEFT JOIN m USING (image_id) {' '.join(f'LEFT JOIN e{k} USING (image_id)' for k in range(4))}")
def i1_scan_result(spark, sf_dir):
    out = Scanner(engines=recorders(*ENGINES), consensus=3).scan(recorded(spark, sf_dir))
    return out.select("image_id", "width", "height", "n", *[F.element_at("per_engine", F.lit(e)).alias(e) for e in ENGINES])


@query(f"{DET}, {folded('det', 0.5)}, {MERGED}, m AS (SELECT image_id, string_agg(voted_by || ':' || vote_count || ':' || source_count || ':' || agreed_payloads, ';' ORDER BY voted_by, vote_count, source_count, agreed_payloads) AS votes FROM merged WHERE vote_count >= 2 GROUP BY 1), r AS (SELECT image_id, string_agg(CAST(det_ix AS VARCHAR), ',' ORDER BY det_ix) AS raw FROM det WHERE engine = 'wechat' GROUP BY 1) SELECT i.image_id, coalesce(votes, '') AS votes, coalesce(raw, '') AS raw, CAST(0 AS BIGINT) AS broken FROM (SELECT DISTINCT image_id FROM det) i LEFT JOIN m USING (image_id) LEFT JOIN r USING (image_id)")
def h2b_whole_results(spark, sf_dir):
    """Votes, raw detections and errors that a scan's results carry."""
    out = Scanner(engines=recorders(*ENGINES), consensus=2).scan(recorded(spark, sf_dir))
    votes = F.transform("detections", lambda d: F.struct(F.array_join(d["voted_by"], ",").alias("v"), d["vote_count"].alias("n"), d["source_count"].alias("s"), F.array_join(d["agreed_payloads"], ",").alias("p")))
    text = F.array_join(F.transform(F.array_sort(votes), lambda x: F.concat_ws(":", x["v"], x["n"], x["s"], x["p"])), ";")
    raw = F.array_join(F.transform(F.element_at("raw", F.lit("wechat")), lambda d: d["extras"]["ix"]), ",")
    return out.select("image_id", text.alias("votes"), raw.alias("raw"), F.size("errors").cast("long").alias("broken"))


#: The size after the automatic downscale, as int() of a product cuts it.
_DOWN = "CASE WHEN greatest(width, height) > 2000 THEN greatest(1, CAST(trunc({0} * (2000.0::DOUBLE / greatest(width, height))) AS INT)) ELSE {0} END"


#: Images that a scan's task gets, some 7500 bytes each.
IMAGES_A_TASK = 2000


class Whole:
    """An engine that finds the image itself, with the size that it was given as payload."""

    name = "whole"

    def detect_and_decode(self, content: bytes) -> list[dict]:
        h, w = decode(content).shape[:2]
        return [{"x1": 0.0, "y1": 0.0, "x2": float(w), "y2": float(h), "symbology": "qr", "payload": f"{w}x{h}", "polygon": [{"x": 0.0, "y": 0.0}, {"x": float(w), "y": float(h)}]}]


@query(f"WITH s AS (SELECT p_partkey AS image_id, CAST(1 + (p_partkey * 7919) % 6000 AS INT) AS width, CAST(1 + p_partkey % 4 AS INT) AS height FROM part) SELECT image_id, width, height, ({_DOWN.format('width')}) || 'x' || ({_DOWN.format('height')}) AS payload, width::DOUBLE AS x2, height::DOUBLE AS y2, width::DOUBLE AS corner_x, height::DOUBLE AS corner_y FROM s")
def b1_auto_scan(spark, sf_dir):
    """Downscaled before the engine, back in the original's pixels after it, box and polygon."""
    k = F.col("p_partkey")
    images = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("image_id"), (1 + k * 7919 % 6000).cast("int").alias("width"), (1 + k % 4).cast("int").alias("height"))
    # a small table may be one partition: dealt out before there are pixels, images of a size to one task, one after another
    parts = max(spark.sparkContext.defaultParallelism, -(-images.count() // IMAGES_A_TASK))
    images = images.repartition(parts, "width").sortWithinPartitions("width")
    content = F.concat(F.format_string("P5\n%d %d\n255\n", "width", "height"), F.repeat(F.lit("x"), F.col("width") * F.col("height")))
    out = Scanner(Whole(), preprocess="auto").scan(images.withColumn("content", F.encode(content, "ISO-8859-1")))
    d = F.col("detections")[0]
    return out.select("image_id", "width", "height", d["payload"].alias("payload"), F.round(d["x2"], 6).alias("x2"), F.round(d["y2"], 6).alias("y2"), F.round(d["polygon"][1]["x"], 6).alias("corner_x"), F.round(d["polygon"][1]["y"], 6).alias("corner_y"))


@query("WITH s AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS input_ix, p_partkey % 5 AS kind FROM part WHERE p_partkey <= 200) SELECT input_ix, kind IN (1, 2) AS bad, CASE WHEN kind IN (1, 2) THEN NULL WHEN kind = 3 THEN 0 ELSE 1 END::INT AS n, kind = 3 AS broken FROM s")
def i6_batch_scan(spark, sf_dir):
    """A batch of inputs, some of them no images, some that break the engine: a row each, in order. The driver reads a batch's inputs, so it is as small as that."""
    keys = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").filter("p_partkey <= 200").orderBy("p_partkey").collect()]
    kinds = [b"P5\n3 2\n255\nabcdef", b"no image", b"P5\n0 2\n255\n", b"P5\n3 2\n255\na", b"P6\n1 1\n255\nabc"]
    out = Scanner(Whole()).scan_batch(spark, [kinds[k % 5] for k in keys])
    return out.select("input_ix", F.col("error").isNotNull().alias("bad"), "n", F.coalesce(F.size("errors") > 0, F.lit(False)).alias("broken"))


# --- geometry -------------------------------------------------------------------------------------------------------

_SIZES = "sizes AS (SELECT p_partkey AS image_id, CAST(1 + (p_partkey * 7919) % 6000 AS INT) AS width, CAST(1 + (p_partkey * 104729) % 4500 AS INT) AS height FROM part)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("image_id"), (1 + k * 7919 % 6000).cast("int").alias("width"), (1 + k * 104729 % 4500).cast("int").alias("height"))


@query(f"WITH {_SIZES}, d AS (SELECT *, {_DOWN.format('width')} AS new_width, {_DOWN.format('height')} AS new_height FROM sizes) SELECT *, round(width::DOUBLE / new_width, 6) AS inv_x, round(height::DOUBLE / new_height, 6) AS inv_y FROM d")
def b1_downscale_geometry(spark, sf_dir):
    w, h = G.downscaled(F.col("width"), F.col("height"))
    return sizes(spark, sf_dir).withColumns({"new_width": w, "new_height": h}).withColumns({"inv_x": F.round(F.col("width") / F.col("new_width"), 6), "inv_y": F.round(F.col("height") / F.col("new_height"), 6)})


@query(f"{DET}, i AS (SELECT *, width::DOUBLE / ({_DOWN.format('width')}) AS sx, height::DOUBLE / ({_DOWN.format('height')}) AS sy FROM (SELECT * REPLACE (width * 2 AS width, height * 2 AS height) FROM det)) SELECT det_ix, round(x1 * sx, 6) AS x1, round(y1 * sy, 6) AS y1, round(x2 * sx, 6) AS x2, round(y2 * sy, 6) AS y2, round(x2 * sx, 6) || ',' || round(y2 * sy, 6) AS third FROM i")
def b4_rescale(spark, sf_dir):
    d = det(spark, sf_dir).withColumn("polygon", G.corners(G.columns()))
    images = d.select("image_id", (F.col("width") * 2).alias("width"), (F.col("height") * 2).alias("height")).distinct()
    out = rescaled(d.drop("width", "height"), images)
    point = F.col("polygon")[2]
    return out.select("det_ix", *[F.round(c, 6).alias(c) for c in G.BOX], F.concat(F.round(point["x"], 6).cast("string"), F.lit(","), F.round(point["y"], 6).cast("string")).alias("third"))


@query(f"WITH {_SIZES}, r AS (SELECT *, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS ratio FROM sizes) SELECT image_id, round(ratio, 6) AS ratio, greatest(1, CAST(trunc(width * ratio) AS INT)) AS new_width, greatest(1, CAST(trunc(height * ratio) AS INT)) AS new_height FROM r")
def b5_letterbox_geometry(spark, sf_dir):
    ratio, w, h = G.letterbox(F.col("width"), F.col("height"))
    return sizes(spark, sf_dir).select("image_id", F.round(ratio, 6).alias("ratio"), w.alias("new_width"), h.alias("new_height"))


# --- post-processing ------------------------------------------------------------------------------------------------

# dims 1-4 of a vector become a box of a 640 square, 5 an objectness, 6-19 class scores; ten vectors are an image
_ANCH = """a AS (SELECT vec_id // 10 AS image_id, vec_id AS anchor_ix, list_transform(embedding, lambda x: x::DOUBLE) AS e, CAST(1280 AS INT) AS width, CAST(960 AS INT) AS height, 0.5::DOUBLE AS ratio FROM embeddings),
  f AS (SELECT image_id, anchor_ix, width, height, ratio, 320 + 400 * e[1] AS cx, 320 + 400 * e[2] AS cy, 100 + 150 * e[3] AS w, 100 + 150 * e[4] AS h, 0.5 + e[5] AS obj, list_transform(e[6:19], lambda x: 0.5 + x) AS c FROM a)"""


def anchors(spark: SparkSession, sf_dir: str, arch: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    box = [320 + 400 * e(1), 320 + 400 * e(2), 100 + 150 * e(3), 100 + 150 * e(4)]
    logit = arch == "rtdetr"
    feat = [b / 640 for b in box] if logit else box
    feat = feat + ([0.5 + e(5)] if arch == "yolox" else []) + [(10 * e(i) if logit else 0.5 + e(i)) for i in range(6, 20)]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 10").alias("image_id"), F.col("vec_id").alias("anchor_ix"), F.array(*feat).alias("feat"), F.lit(0.5).alias("ratio"), F.lit(1280).alias("width"), F.lit(960).alias("height"))


_BOX = "cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2"
_NEAR = "greatest(0.0, x1 / ratio) AS x1, greatest(0.0, y1 / ratio) AS y1, least(width::DOUBLE, x2 / ratio) AS x2, least(height::DOUBLE, y2 / ratio) AS y2"
_BOTH = "least(width::DOUBLE, greatest(0.0, x1 / ratio)) AS x1, least(height::DOUBLE, greatest(0.0, y1 / ratio)) AS y1, least(width::DOUBLE, greatest(0.0, x2 / ratio)) AS x2, least(height::DOUBLE, greatest(0.0, y2 / ratio)) AS y2"
_OUT = "image_id, anchor_ix, class_id, round(score, 6) AS score, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "anchor_ix", "class_id", F.round("score", 6).alias("score"), *[F.round(c, 4).alias(c) for c in G.BOX])


def _scored(layout: str) -> str:
    best = "list_max(c)"
    score = {"yolox": f"{best} * obj", "yolo11": best, "rtdetr": f"1 / (1 + exp(-10 * ({best} - 0.5)))"}[layout]
    return f"{_ANCH}, k AS (SELECT * FROM (SELECT image_id, anchor_ix, width, height, ratio, {_BOX}, {score} AS score, CAST(list_position(c, {best}) - 1 AS INT) AS class_id FROM f) WHERE score >= 0.25)"


for _arch, _clip in (("yolox", _NEAR), ("yolo11", _BOTH), ("rtdetr", _BOTH)):
    _where = " WHERE x2 > x1 AND y2 > y1" if _arch == "yolox" else ""
    query(f"WITH {_scored(_arch)}, u AS (SELECT * REPLACE ({', '.join(x.replace(' AS ', ' AS ') for x in [_clip])}) FROM k) SELECT {_OUT} FROM u{_where}", f"d_{_arch}_decode")(
        lambda spark, sf_dir, a=_arch, c=_clip: _rounded(P.unscaled(P.scored(anchors(spark, sf_dir, a), a), "near" if c == _NEAR else "both").filter(F.expr("x2 > x1 and y2 > y1") if a == "yolox" else F.lit(True)))
    )


def _nms_sql(layout: str) -> str:
    clip = {"yolox": "", "yolo11": f", m AS (SELECT * REPLACE ({_BOTH}) FROM k)"}[layout]
    source = {"yolox": "k", "yolo11": "m"}[layout]
    fold = f"""g AS (SELECT image_id, class_id, list({{'ix': anchor_ix, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, anchor_ix) AS b FROM {source} GROUP BY 1, 2),
      s AS (SELECT image_id, class_id, unnest(list_reduce(b, lambda acc, c: CASE WHEN len(list_filter(acc.k, lambda o: {iou_sql("o", "c", False)} >= 0.45)) > 0 THEN acc ELSE {{'k': list_append(acc.k, c)}} END, {{'k': b[1:0]}}).k).ix AS ix FROM g)"""
    last = f"SELECT * REPLACE ({_NEAR}) FROM kept" if layout == "yolox" else "SELECT * FROM kept"
    where = " WHERE x2 > x1 AND y2 > y1" if layout == "yolox" else ""
    return f"WITH {_scored(layout)}{clip}, {fold}, kept AS (SELECT {source}.* FROM {source} JOIN s ON s.ix = anchor_ix), z AS ({last}) SELECT {_OUT} FROM z{where}"


for _arch, _key in (("yolox", "d7_nms"), ("yolo11", "d8_nms_clipped")):
    query(_nms_sql(_arch), _key)(lambda spark, sf_dir, a=_arch: _rounded(P.detections(anchors(spark, sf_dir, a), a)))


@query(f"WITH {_scored('rtdetr')} SELECT image_id, count(*) AS n, round(max(score), 6) AS best FROM k GROUP BY 1")
def d9_no_nms(spark, sf_dir):
    return P.detections(anchors(spark, sf_dir, "rtdetr"), "rtdetr").groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query(f"{DET}, g AS (SELECT image_id, symbology, list({{'ix': det_ix, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, det_ix) AS b FROM det GROUP BY 1, 2) SELECT image_id, symbology, unnest(list_reduce(b, lambda acc, c: CASE WHEN len(list_filter(acc.k, lambda o: {iou_sql('o', 'c', False)} >= 0.45)) > 0 THEN acc ELSE {{'k': list_append(acc.k, c)}} END, {{'k': b[1:0]}}).k).ix AS det_ix FROM g")
def d7_nms_detections(spark, sf_dir):
    return suppressed(det(spark, sf_dir).select("image_id", "symbology", "det_ix", "score", *G.BOX), P.NMS, ("image_id", "symbology")).select("image_id", "symbology", "det_ix")


@query(f"WITH {_scored('yolo11')}, u AS (SELECT * REPLACE ({_BOTH}) FROM k) SELECT image_id, anchor_ix, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, anchor_ix) - 1 AS INT) AS det_ix FROM u")
def d13_rank(spark, sf_dir):
    return P.ranked(P.unscaled(P.scored(anchors(spark, sf_dir, "yolo11"), "yolo11"), "both")).select("image_id", "anchor_ix", "det_ix")


for _classes in (14, 9, 7):
    _names = {14: SYMBOLOGIES[:14], 9: "qr code_128 data_matrix code_39 code_93 pdf417 gs1_databar other_1d micro_qr".split(), 7: []}[_classes]
    _cases = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_names)) or "WHEN -1 THEN ''"
    query(f"WITH {_scored('yolo11')} SELECT anchor_ix, class_id, coalesce(CASE class_id {_cases} END, 'other_1d') AS symbology, coalesce(CASE class_id {_cases} END, 'unknown') AS class_name FROM k", f"d14_class_lookup_{_classes}")(
        lambda spark, sf_dir, n=_classes: P.with_symbology(P.scored(anchors(spark, sf_dir, "yolo11"), "yolo11"), n).select("anchor_ix", "class_id", "symbology", "class_name")
    )

# --- staged decoding ------------------------------------------------------------------------------------------------


def _crop_sql(factor: str, least: int) -> str:
    pad = f"greatest({least}.0, {factor} * least(x2 - x1, y2 - y1))"
    return f"greatest(0, CAST(trunc(x1 - {pad}) AS INT)) AS cx1, greatest(0, CAST(trunc(y1 - {pad}) AS INT)) AS cy1, least(width, CAST(trunc(x2 + {pad}) AS INT)) AS cx2, least(height, CAST(trunc(y2 + {pad}) AS INT)) AS cy2"


@query(f"{DET}, s AS (SELECT unnest([{{'i': 0, 'f': 0.05::DOUBLE, 'n': 'tight'}}, {{'i': 1, 'f': 0.15::DOUBLE, 'n': 'medium'}}, {{'i': 2, 'f': 0.3::DOUBLE, 'n': 'large'}}]) AS z), c AS (SELECT det_ix, z.i AS stage_ix, z.n AS stage, {_crop_sql('z.f', 4)} FROM det, s) SELECT * FROM c WHERE cx2 > cx1 AND cy2 > cy1")
def e1_crop_ladder(spark, sf_dir):
    return D.crop_ladder(det(spark, sf_dir)).select("det_ix", "stage_ix", "stage", "cx1", "cy1", "cx2", "cy2")


# a read fails or succeeds by the user's number: attempts of three stages
_ATTEMPTS = "t AS (SELECT det_ix, symbology, i AS stage_ix, ['tight', 'medium', 'large'][i + 1] AS stage, CASE WHEN payload IS NOT NULL AND (user_id + i) % 4 = 0 THEN payload || '-' || i END AS payload FROM det, (SELECT unnest([0, 1, 2]) AS i))"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).withColumn("stage_ix", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    name = F.element_at(F.array(*[F.lit(n) for _, n in D.LADDER]), F.col("stage_ix") + 1)
    read = F.when(F.col("payload").isNotNull() & ((F.col("user_id") + F.col("stage_ix")) % 4 == 0), F.concat("payload", F.lit("-"), F.col("stage_ix").cast("string")))
    return rows.select("det_ix", "symbology", "stage_ix", name.alias("stage"), read.alias("payload"))


@query(f"{DET}, {_ATTEMPTS} SELECT det_ix, first(payload ORDER BY stage_ix) FILTER (payload IS NOT NULL) AS payload, first(stage ORDER BY stage_ix) FILTER (payload IS NOT NULL) AS stage FROM t GROUP BY 1")
def e2_first_stage(spark, sf_dir):
    return D.first_success(attempts(spark, sf_dir), ["det_ix"])


@query(f"{DET}, r AS (SELECT image_id, det_ix AS read_ix, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, payload FROM det WHERE engine = 'zxing' AND payload IS NOT NULL), b AS (SELECT * FROM det WHERE engine = 'native') SELECT b.image_id, b.det_ix, first(r.payload ORDER BY read_ix) AS payload, count(*) AS reads_inside FROM b JOIN r ON b.image_id = r.image_id AND cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2 GROUP BY 1, 2")
def e3_fallback_join(spark, sf_dir):
    d = det(spark, sf_dir)
    reads = d.filter("engine = 'zxing' and payload is not null").select("image_id", F.col("det_ix").alias("read_ix"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.col("payload").alias("read_payload"))
    return D.fallback_reads(d.filter("engine = 'native'").drop("payload"), reads, ["image_id", "det_ix"])


@query(f"{DET} SELECT det_ix, payload IS NULL AND symbology IN ('data_matrix', 'qr', 'micro_qr', 'aztec') AS asked FROM (SELECT det_ix, CASE WHEN user_id % 3 > 0 THEN payload END AS payload, symbology FROM det)")
def e5_fallback_gate(spark, sf_dir):
    d = det(spark, sf_dir).withColumn("payload", F.when(F.col("user_id") % 3 > 0, F.col("payload")))
    return d.select("det_ix", D.gate(F.col("payload"), F.col("symbology")).alias("asked"))


@query(f"{DET}, c AS (SELECT det_ix, {_crop_sql('0.25::DOUBLE', 8)} FROM det) SELECT *, round(greatest(1.0, 300.0::DOUBLE / least(cx2 - cx1, cy2 - cy1)), 6) AS upscale FROM c WHERE least(cx2 - cx1, cy2 - cy1) >= 4")
def e6_fallback_crop(spark, sf_dir):
    return D.fallback_crop(det(spark, sf_dir)).select("det_ix", "cx1", "cy1", "cx2", "cy2", F.round("upscale", 6).alias("upscale"))


_DECODER = "CASE det_ix % 3 WHEN 0 THEN 'libdmtx' WHEN 1 THEN 'zxing' ELSE 'none' END"
_DECODED = "CASE WHEN det_ix % 3 = 1 AND det_ix % 2 = 0 THEN 'aztec' END"


@query(f"{DET}, r AS (SELECT det_ix, {_DECODER} AS decoder, symbology AS detector, CASE WHEN {_DECODER} = 'libdmtx' THEN 'data_matrix' ELSE coalesce({_DECODED}, symbology) END AS final FROM det) SELECT det_ix, final AS symbology, decoder, CASE WHEN detector <> final THEN upper(detector) END AS detector_symbology FROM r")
def e7_reconcile(spark, sf_dir):
    d = det(spark, sf_dir).withColumns({"decoder": F.expr(_DECODER), "decoded": F.expr(_DECODED)})
    d = d.withColumn("final", D.reconciled(F.col("decoder"), F.col("decoded"), F.col("symbology")))
    d = d.withColumn("extras", D.extras(F.col("decoder"), F.lit(0), F.lit("x"), F.lit("tight"), F.col("symbology"), F.col("final")))
    return d.select("det_ix", F.col("final").alias("symbology"), F.col("extras")["decoder"].alias("decoder"), F.col("extras")["detector_symbology"].alias("detector_symbology"))


@query(f"{DET}, r AS (SELECT det_ix, {_DECODER} AS decoder, symbology AS detector, CASE WHEN {_DECODER} = 'libdmtx' THEN 'data_matrix' ELSE coalesce({_DECODED}, symbology) END AS final, CASE WHEN user_id % 2 = 0 THEN 'tight' END AS stage FROM det) SELECT det_ix, 'decode_stage=' || coalesce(stage, '') || ' decoder=' || decoder || ' detector_symbology=' || coalesce(CASE WHEN detector <> final THEN upper(detector) END, '') || ' model_class_id=' || (det_ix % 14) || ' model_class_name=' || detector AS extras, 3 + CAST(stage IS NOT NULL AS INT) + CAST(detector <> final AS INT) AS keys FROM r")
def e8_extras(spark, sf_dir):
    d = det(spark, sf_dir).withColumns({"decoder": F.expr(_DECODER), "decoded": F.expr(_DECODED), "stage": F.when(F.col("user_id") % 2 == 0, "tight")})
    final = D.reconciled(F.col("decoder"), F.col("decoded"), F.col("symbology"))
    d = d.withColumn("extras", D.extras(F.col("decoder"), F.col("det_ix") % 14, F.col("symbology"), F.col("stage"), F.col("symbology"), final))
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(F.col("extras")[k], F.lit(""))) for k in ("decode_stage", "decoder", "detector_symbology", "model_class_id", "model_class_name")]
    return d.select("det_ix", F.concat_ws(" ", *pairs).alias("extras"), F.size("extras").alias("keys"))


# --- lookups --------------------------------------------------------------------------------------------------------

#: Fixed values, spelled out apart from the implementation's own table.
_VALUES = """fmt AS (SELECT * FROM (VALUES
  ('zxing', 'QRCode', 'qr', 'map'), ('zxing', 'Aztec', 'aztec', 'map'), ('zxing', 'DataMatrix', 'data_matrix', 'map'), ('zxing', 'PDF417', 'pdf417', 'map'),
  ('zxing', 'Code128', 'code_128', 'map'), ('zxing', 'Code39', 'code_39', 'map'), ('zxing', 'Code93', 'code_93', 'map'), ('zxing', 'EAN13', 'ean_13', 'map'),
  ('zxing', 'EAN8', 'ean_8', 'map'), ('zxing', 'UPCA', 'upc_a', 'map'), ('zxing', 'UPCE', 'upc_e', 'map'), ('zxing', 'MicroQRCode', 'micro_qr', 'map'),
  ('zxing', 'Codabar', 'codabar', 'map'), ('zxing', 'ITF', 'itf', 'map'), ('zxing', 'MaxiCode', 'maxicode', 'map'),
  ('zxing', 'DataBar', 'gs1_databar', 'map'), ('zxing', 'DataBarOmni', 'gs1_databar', 'map'), ('zxing', 'DataBarStk', 'gs1_databar', 'map'),
  ('zxing', 'DataBarStkOmni', 'gs1_databar', 'map'), ('zxing', 'DataBarLtd', 'gs1_databar', 'map'), ('zxing', 'DataBarLimited', 'gs1_databar', 'map'),
  ('zxing', 'DataBarExp', 'gs1_databar', 'map'), ('zxing', 'DataBarExpanded', 'gs1_databar', 'map'), ('zxing', 'DataBarExpStk', 'gs1_databar', 'map'),
  ('zxing', 'DataBarExpandedStacked', 'gs1_databar', 'map'),
  ('zxing', 'MicroPDF417', NULL, 'drop'), ('zxing', 'RMQRCode', NULL, 'drop'), ('zxing', 'DXFilmEdge', NULL, 'drop'),
  ('apple_vision', 'VNBarcodeSymbologyQR', 'qr', 'map'), ('apple_vision', 'VNBarcodeSymbologyMicroQR', 'micro_qr', 'map'), ('apple_vision', 'VNBarcodeSymbologyAztec', 'aztec', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyDataMatrix', 'data_matrix', 'map'), ('apple_vision', 'VNBarcodeSymbologyPDF417', 'pdf417', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyCode128', 'code_128', 'map'), ('apple_vision', 'VNBarcodeSymbologyCode39', 'code_39', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyCode39Checksum', 'code_39', 'map'), ('apple_vision', 'VNBarcodeSymbologyCode39FullASCII', 'code_39', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyCode39FullASCIIChecksum', 'code_39', 'map'), ('apple_vision', 'VNBarcodeSymbologyCode93', 'code_93', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyCode93i', 'code_93', 'map'), ('apple_vision', 'VNBarcodeSymbologyEAN13', 'ean_13', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyEAN8', 'ean_8', 'map'), ('apple_vision', 'VNBarcodeSymbologyUPCE', 'upc_e', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyGS1DataBar', 'gs1_databar', 'map'), ('apple_vision', 'VNBarcodeSymbologyGS1DataBarExpanded', 'gs1_databar', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyGS1DataBarLimited', 'gs1_databar', 'map'), ('apple_vision', 'VNBarcodeSymbologyCodabar', 'codabar', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyI2of5', 'itf', 'map'), ('apple_vision', 'VNBarcodeSymbologyI2of5Checksum', 'itf', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyITF14', 'itf', 'map'), ('apple_vision', 'VNBarcodeSymbologyMSIPlessey', 'other_1d', 'map'),
  ('apple_vision', 'VNBarcodeSymbologyMicroPDF417', NULL, 'drop')) AS v(decoder, raw_format, symbology, action))"""
_RAW = ["QRCode", "DataBarLimited", "MicroPDF417", "Code128", "Unheard", "MaxiCode", "RMQRCode"]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("det_ix") % len(_RAW) + 1).cast("int"))
    return det(spark, sf_dir).select("det_ix", F.lit("zxing").alias("decoder"), raw.alias("raw_format"))


_RAW_SQL = f"raw AS (SELECT det_ix, 'zxing' AS decoder, ['{"', '".join(_RAW)}'][det_ix % {len(_RAW)} + 1] AS raw_format FROM det)"


@query(f"{DET}, {_VALUES}, {_RAW_SQL} SELECT raw.*, fmt.symbology AS mapped FROM raw LEFT JOIN fmt ON raw.decoder = fmt.decoder AND raw.raw_format = fmt.raw_format AND action = 'map'")
def f3_format_keep(spark, sf_dir):
    return D.mapped_formats(_raw(spark, sf_dir), dim_decoder_format(spark), drop=False).select("det_ix", "decoder", "raw_format", "mapped")


@query(f"{DET}, {_VALUES}, {_RAW_SQL} SELECT raw.*, fmt.symbology AS mapped FROM raw JOIN fmt ON raw.decoder = fmt.decoder AND raw.raw_format = fmt.raw_format AND action = 'map'")
def f4_format_drop(spark, sf_dir):
    return D.mapped_formats(_raw(spark, sf_dir), dim_decoder_format(spark), drop=True).select("det_ix", "decoder", "raw_format", "mapped")


@query(f"{DET}, {_VALUES}, {_RAW_SQL} SELECT raw.*, fmt.symbology FROM raw JOIN fmt ON raw.decoder = fmt.decoder AND raw.raw_format = fmt.raw_format WHERE fmt.symbology IN ('qr', 'code_128', 'maxicode')")
def f7_requested_formats(spark, sf_dir):
    rows = A.restricted(_raw(spark, sf_dir), "zxing", ["maxicode", "qr", "code_128"])
    return D.mapped_formats(rows, dim_decoder_format(spark), drop=True).select("det_ix", "decoder", "raw_format", F.col("mapped").alias("symbology"))


@query(f"WITH {_VALUES} SELECT symbology, string_agg(raw_format, ',' ORDER BY raw_format) AS names FROM fmt WHERE decoder = 'apple_vision' AND action = 'map' AND symbology <> 'other_1d' GROUP BY 1")
def f5_requestable(spark, sf_dir):
    asked = spark.createDataFrame(list(requestable("apple_vision").items()), "symbology string, names array<string>")
    return asked.select("symbology", F.array_join(F.array_sort("names"), ",").alias("names"))


@query(f"WITH {_VALUES} SELECT * FROM fmt")
def f6_format_table(spark, sf_dir):
    return dim_decoder_format(spark)


@query("WITH p AS (SELECT p_partkey, CAST(p_partkey % 20 AS INT) AS class_id FROM part) SELECT class_id, CASE class_id " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYMBOLOGIES)) + " END AS symbology, count(*) AS n FROM p GROUP BY 1, 2")
def f1_from_class_id(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 20).cast("int").alias("class_id"))
    return ids.groupBy("class_id").agg(F.count("*").alias("n")).join(F.broadcast(dim_symbology(spark)), "class_id", "left").select("class_id", "symbology", "n")


# --- engine adapters ------------------------------------------------------------------------------------------------


# raw reads of the three engines, some of them invalid, of unknown formats, empty or without area
_FLAT = "CASE WHEN user_id % 11 = 0 THEN x1 ELSE x2 END"


def _polygon(d: DataFrame) -> DataFrame:
    flat = d.withColumn("x2", F.when(F.col("user_id") % 11 == 0, F.col("x1")).otherwise(F.col("x2")))
    return flat.withColumn("polygon", G.corners(G.columns()))


@query(f"{DET}, {_VALUES}, {_RAW_SQL}, z AS (SELECT det.*, raw_format FROM det JOIN raw USING (det_ix) WHERE engine = 'zxing' AND user_id % 7 <> 0 AND user_id % 11 <> 0) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY det_ix) - 1 AS INT) AS det_ix, fmt.symbology, coalesce(payload, 'x') AS payload, x1, y1, x2, y2, 1.0::DOUBLE AS score, CASE WHEN user_id % 3 > 0 THEN 'M' END AS ec_level FROM z JOIN fmt ON fmt.decoder = 'zxing' AND fmt.raw_format = z.raw_format AND action = 'map'")
def g2_zxing_adapter(spark, sf_dir):
    d = _polygon(det(spark, sf_dir).filter("engine = 'zxing'")).withColumn("text", F.coalesce("payload", F.lit("x")))
    raw = d.join(_raw(spark, sf_dir).select("det_ix", "raw_format"), "det_ix").select("image_id", F.col("det_ix").alias("read_ix"), (F.col("user_id") % 7 != 0).alias("valid"), "raw_format", "text", "polygon", F.lit("]Q1").alias("identifier"), F.when(F.col("user_id") % 3 > 0, "M").otherwise("").alias("ec_level"))
    return A.zxing(raw).select("image_id", "det_ix", "symbology", "payload", *G.BOX, "score", F.col("extras")["ec_level"].alias("ec_level"))


@query(f"{DET}, w AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_ix) AS r FROM det WHERE engine = 'wechat') SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY (x2 - x1) * (y2 - y1) DESC, r) - 1 AS INT) AS det_ix, payload, x1, y1, x2, y2 FROM w WHERE payload IS NOT NULL AND user_id % 11 <> 0 AND user_id % 5 <> 0")
def g3_wechat_adapter(spark, sf_dir):
    points = F.when(F.col("user_id") % 5 == 0, F.slice("polygon", 1, 3)).otherwise(F.col("polygon"))
    d = _polygon(det(spark, sf_dir).filter("engine = 'wechat'")).select("image_id", "det_ix", F.coalesce("payload", F.lit("")).alias("text"), points.alias("points"))
    every = F.array_sort(F.collect_list(F.struct("det_ix", "text", "points")))
    raw = d.groupBy("image_id").agg(every.alias("a")).select("image_id", F.col("a.text").alias("texts"), F.col("a.points").alias("points"))
    return A.wechat(raw).select("image_id", "det_ix", "payload", *G.BOX)


@query(f"{DET}, v AS (SELECT *, ['VNBarcodeSymbologyQR', 'VNBarcodeSymbologyCode93i', 'VNBarcodeSymbologyMicroPDF417', 'VNBarcodeSymbologyMSIPlessey', 'Unheard'][det_ix % 5 + 1] AS raw_format FROM det WHERE engine = 'apple_vision' AND payload IS NOT NULL) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, v.det_ix) - 1 AS INT) AS det_ix, CASE raw_format WHEN 'VNBarcodeSymbologyQR' THEN 'qr' WHEN 'VNBarcodeSymbologyCode93i' THEN 'code_93' ELSE 'other_1d' END AS symbology, score, round(x1 / 400 * width, 6) AS x1, round((1 - y2 / 300) * height, 6) AS y1, round(x2 / 400 * width, 6) AS x2, round((1 - y1 / 300) * height, 6) AS y2 FROM v WHERE raw_format IN ('VNBarcodeSymbologyQR', 'VNBarcodeSymbologyCode93i', 'VNBarcodeSymbologyMSIPlessey')")
def g4_vision_adapter(spark, sf_dir):
    names = ["VNBarcodeSymbologyQR", "VNBarcodeSymbologyCode93i", "VNBarcodeSymbologyMicroPDF417", "VNBarcodeSymbologyMSIPlessey", "Unheard"]
    raw = det(spark, sf_dir).filter("engine = 'apple_vision'").withColumn("polygon", G.corners(G.columns()))
    corners = F.transform("polygon", lambda p: F.struct((p["x"] / 400).alias("x"), (p["y"] / 300).alias("y")))
    raw = raw.select("image_id", F.col("det_ix").alias("read_ix"), F.element_at(F.array(*map(F.lit, names)), F.col("det_ix") % 5 + 1).alias("raw_format"), F.coalesce("payload", F.lit("")).alias("payload"), F.col("score").alias("confidence"), corners.alias("corners"), "width", "height")
    return A.apple_vision(raw).select("image_id", "det_ix", "symbology", "score", *[F.round(c, 6).alias(c) for c in G.BOX])


@query(f"{DET} SELECT det_ix, CAST(least(x1, x2 - 7) AS DOUBLE) AS x1, y1, x2, y2 + 5 AS y2 FROM det")
def g8_poly_bbox(spark, sf_dir):
    """The box of a quadrangle whose corners lean."""
    x1, y1, x2, y2 = (F.col(c) for c in G.BOX)
    lean = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1 + 5), (x2 - 7, y2 + 5), (x1 + 3, y2))])
    return det(spark, sf_dir).withColumn("polygon", lean).select("det_ix", *[v.alias(k) for k, v in G.bounds(F.col("polygon")).items()])


@query("SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000000000 AS VARCHAR), 12, '0') AS digits, CAST((10 - (list_sum(list_transform(range(1, 13), lambda i: CAST(lpad(CAST(o_orderkey * 7919 % 1000000000000 AS VARCHAR), 12, '0')[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10) % 10 AS INT) AS digit FROM orders")
def l2_ean13_check_digit(spark, sf_dir):
    digits = F.lpad((F.col("o_orderkey") * 7919 % 1000000000000).cast("string"), 12, "0")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", digits.alias("digits")).withColumn("digit", G.check_digit(F.col("digits")).cast("int"))


@query("WITH g AS (SELECT p_partkey // 7 AS canvas, p_partkey % 7 AS piece, 20 + p_size AS w, 20 + p_size // 2 AS h FROM part), c AS (SELECT canvas, max(w) + 60 AS cw, max(h) + 60 AS ch FROM g GROUP BY 1) SELECT canvas, piece, CAST((rank() OVER (PARTITION BY canvas ORDER BY piece) - 1) % 3 * cw + (cw - w) // 2 AS INT) AS x, CAST((rank() OVER (PARTITION BY canvas ORDER BY piece) - 1) // 3 * ch + (ch - h) // 2 AS INT) AS y FROM g JOIN c USING (canvas)")
def l6_grid_layout(spark, sf_dir):
    """Seven pieces a canvas, placed by the composer's own layout."""
    k = F.col("p_partkey")
    pieces = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("p_partkey div 7").alias("canvas"), (k % 7).alias("piece"), (20 + F.col("p_size")).alias("w"), F.expr("20 + p_size div 2").alias("h"))

    @F.pandas_udf("array<struct<x:int,y:int>>")
    def places(canvases: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in corpus.grid([(p["w"], p["h"]) for p in c])[1]] for c in canvases])

    whole = pieces.groupBy("canvas").agg(F.array_sort(F.collect_list(F.struct("piece", "w", "h"))).alias("all")).withColumn("at", places("all"))
    return whole.select("canvas", F.explode(F.arrays_zip("all", "at")).alias("z")).select("canvas", "z.all.piece", "z.at.x", "z.at.y")


_CLEAN_SQL = """SELECT * FROM (VALUES
  ('qr-url', 'qr', 'https://example.org/test'), ('qr-plain', 'qr', 'Hello, world!'), ('qr-unicode', 'qr', 'こんにちは 世界'), ('qr-json', 'qr', '{"v":1,"id":"abc123","ok":true}'),
  ('qr-vcardish', 'qr', 'MECARD:N:Example,Test;TEL:+15551234;EMAIL:hi@example.org;;'), ('qr-long-ascii', 'qr', 'CODES' || repeat('0123456789', 12)),
  ('c128-alphanum', 'code_128', 'CODES-128-TEST'), ('c128-digits', 'code_128', '20260513123456'), ('c128-mixed', 'code_128', 'SN:ABCD-1234'), ('c128-slash', 'code_128', 'PO/47291/A'),
  ('c39-alpha', 'code_39', 'CODES39'), ('c39-part', 'code_39', 'PART-12345'), ('c39-plus', 'code_39', 'RUN+001'),
  ('ean13-seq', 'ean_13', '0123456789012'), ('ean13-zero-prefix', 'ean_13', '2000000000015'), ('ean13-typical', 'ean_13', '7501000000012')) AS v(spec_id, symbology, payload)"""


@query(_CLEAN_SQL)
def l3_clean_corpus(spark, sf_dir):
    """Drawn, scanned by the clean-code reader, and read as planted."""
    images = corpus.clean(spark)
    found = Scanner(Plain()).scan(images).select("image_id", F.explode("detections").alias("d"))
    return images.select("image_id", "spec_id").join(found, "image_id").select("spec_id", "d.symbology", "d.payload")


@query("""SELECT * FROM (VALUES
  ('multi-three-qrs-flat', 'https://example.org/multi-a', 'qr'), ('multi-three-qrs-flat', 'https://example.org/multi-b', 'qr'), ('multi-three-qrs-flat', 'https://example.org/multi-c', 'qr'),
  ('multi-mixed-flat', 'https://example.org/mix', 'qr'), ('multi-mixed-flat', 'CODES-MIX-128', 'code_128'), ('multi-mixed-flat', '0123456789012', 'ean_13')) AS v(spec_id, payload, symbology)""")
def l4_composite_corpus(spark, sf_dir):
    """The images of several codes that none is turned in."""
    images = corpus.composite(spark).filter("spec_id like '%-flat'")
    found = Scanner(Plain()).scan(images).select("image_id", F.explode("detections").alias("d"))
    return images.select("image_id", "spec_id").join(found, "image_id").select("spec_id", "d.payload", "d.symbology")


# --- corpus metrics -------------------------------------------------------------------------------------------------


@query(f"{DET} SELECT count(DISTINCT image_id) AS images FROM det WHERE payload IS NOT NULL")
def k1_images_with_code(spark, sf_dir):
    return M.images_with_code(det(spark, sf_dir))


@query(f"{DET} SELECT count(DISTINCT payload) AS codes FROM det")
def k2_distinct_codes(spark, sf_dir):
    return M.distinct_codes(det(spark, sf_dir))


_MEASURE = "count(DISTINCT CASE WHEN payload IS NOT NULL THEN image_id END) AS images, count(DISTINCT payload) AS codes"


@query(f"{DET}, {folded('det', 0.5)}, {MERGED} SELECT engine AS configuration, {_MEASURE} FROM det GROUP BY 1 UNION ALL SELECT 'union', {_MEASURE} FROM merged UNION ALL SELECT 'consensus_2', {_MEASURE} FROM merged WHERE vote_count >= 2 UNION ALL SELECT 'consensus_3', {_MEASURE} FROM merged WHERE vote_count >= 3")
def k3_yield_by_configuration(spark, sf_dir):
    return M.yield_by_configuration(det(spark, sf_dir))


@query(f"{DET} SELECT symbology, {', '.join(f"count(DISTINCT payload) FILTER (engine = '{e}') AS {e}" for e in ENGINES)}, count(DISTINCT payload) AS \"union\" FROM det GROUP BY 1")
def k4_yield_by_symbology(spark, sf_dir):
    return M.yield_by_symbology(det(spark, sf_dir), list(ENGINES))


@query(f"{DET}, {folded('det', 0.5)}, {MERGED} SELECT CASE WHEN vote_count = 1 THEN voted_by ELSE 'corroborated' END AS engine, count(*) AS clusters FROM merged GROUP BY 1")
def k5_exclusive(spark, sf_dir):
    return M.exclusive(det(spark, sf_dir))


@query(f"{DET} SELECT engine, count(*) AS n_detections, count(payload) AS n_decoded, count(DISTINCT payload) AS n_unique_payloads, count(DISTINCT CASE WHEN payload IS NOT NULL THEN image_id END) AS n_decoded_images, round(count(payload)::DOUBLE / count(*), 6) AS decode_rate FROM det GROUP BY 1")
def k6_engine_decodes(spark, sf_dir):
    return M.engine_decodes(det(spark, sf_dir)).withColumn("decode_rate", F.round("decode_rate", 6))


@query(f"{DET}, src AS (SELECT * FROM det WHERE payload IS NOT NULL), {folded('src', 0.5)}, c AS (SELECT count(DISTINCT engine) AS v FROM cl GROUP BY image_id, seed) SELECT CAST(v AS INT) AS vote_count, count(*) AS clusters FROM c GROUP BY 1")
def k7_decoded_clusters(spark, sf_dir):
    return M.decoded_clusters(det(spark, sf_dir))


@query(f"{DET}, {folded('det', 0.5)}, a AS (SELECT image_id, seed, payload, count(DISTINCT engine) AS n FROM cl WHERE payload IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT max(n) AS agreeing FROM a GROUP BY image_id, seed) SELECT agreeing, count(*) AS clusters FROM m GROUP BY 1")
def k8_payload_agreement(spark, sf_dir):
    return M.payload_agreement(M.read_clusters(det(spark, sf_dir)))


@query(f"{DET}, c AS (SELECT DISTINCT engine, image_id, symbology, payload FROM det WHERE payload IS NOT NULL), u AS (SELECT count(*) AS universe FROM (SELECT DISTINCT image_id, symbology, payload FROM c)) SELECT engine, count(*) AS codes, any_value(universe) AS universe, round(count(*)::DOUBLE / any_value(universe), 6) AS recall FROM c, u GROUP BY 1")
def k9_payload_recall(spark, sf_dir):
    return M.payload_recall(det(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


@query(f"{DET}, o AS (SELECT min(engine) AS engine FROM det WHERE payload IS NOT NULL GROUP BY image_id, symbology, payload HAVING count(DISTINCT engine) = 1) SELECT engine, count(*) AS codes FROM o GROUP BY 1")
def k10_unique_decodes(spark, sf_dir):
    return M.unique_decodes(det(spark, sf_dir))


@query(f"{DET}, q AS (SELECT DISTINCT engine, image_id, payload FROM det WHERE symbology = 'qr' AND payload IS NOT NULL) SELECT engine, image_id, payload FROM q WHERE engine <> 'wechat' AND NOT EXISTS (SELECT 1 FROM q w WHERE w.engine = 'wechat' AND w.image_id = q.image_id AND w.payload = q.payload)")
def k11_head_to_head(spark, sf_dir):
    return M.lacking(det(spark, sf_dir), "wechat", "qr").select("engine", "image_id", "payload")


@query(f"{DET}, {folded('det', 0.5)}, r AS (SELECT DISTINCT image_id, seed, payload, engine FROM cl WHERE payload IS NOT NULL), v AS (SELECT image_id, seed, payload FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2), e AS (SELECT unnest(['{"', '".join(ENGINES)}']) AS engine), x AS (SELECT e.engine, EXISTS (SELECT 1 FROM r WHERE r.image_id = v.image_id AND r.seed = v.seed AND r.payload = v.payload AND r.engine = e.engine) AS hit, EXISTS (SELECT 1 FROM r WHERE r.image_id = v.image_id AND r.seed = v.seed AND r.engine = e.engine) AS red FROM v, e) SELECT engine, count(*) AS universe, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit AND red) AS disagreed, count(*) FILTER (NOT red) AS missed, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS correctness, round(count(*) FILTER (NOT hit AND red)::DOUBLE / count(*) FILTER (red), 6) AS disagreement FROM x GROUP BY 1")
def k12_validated_recall(spark, sf_dir):
    out = M.validated_recall(M.read_clusters(det(spark, sf_dir)), list(ENGINES))
    return out.withColumns({c: F.round(c, 6) for c in ("correctness", "disagreement")})


def _greedy_sql() -> str:
    """Four steps, each the engine with the most codes that no earlier one has; ties go to the earlier engine."""
    steps = "m AS (SELECT bit_or(1 << engine_rank) AS mask FROM det WHERE payload IS NOT NULL GROUP BY image_id, symbology, payload), e AS (SELECT unnest([0, 1, 2, 3]) AS i), s0 AS (SELECT 0 AS seen, 0 AS i, 0::BIGINT AS gained)"
    for k in range(1, 5):
        steps += f", s{k} AS (SELECT s.seen | (1 << e.i) AS seen, e.i, (SELECT count(*) FROM m WHERE (m.mask >> e.i) & 1 = 1 AND m.mask & s.seen = 0) AS gained FROM s{k - 1} s, e WHERE (s.seen >> e.i) & 1 = 0 ORDER BY gained DESC, i LIMIT 1)"
    union = " UNION ALL ".join(f"SELECT {k} AS step, i, gained FROM s{k}" for k in range(1, 5))
    return f"{DET}, {steps} SELECT CAST(step AS INT) AS step, ['{"', '".join(ENGINES)}'][i + 1] AS engine, CAST(gained AS BIGINT) AS gained, CAST(sum(gained) OVER (ORDER BY step) AS BIGINT) AS covered FROM ({union})"


@query(_greedy_sql())
def k13_greedy_coverage(spark, sf_dir):
    return M.greedy_coverage(det(spark, sf_dir), list(ENGINES))


_STATS = "s AS (SELECT engine, avg(ms) AS ms, count(payload)::DOUBLE / count(*) AS recall FROM det GROUP BY 1)"


@query(f"{DET}, {_STATS}, m AS (SELECT median(ms) AS m, median(recall) AS r FROM s) SELECT engine, CASE WHEN ms <= m THEN 'fast' ELSE 'slow' END || '_' || CASE WHEN recall >= r THEN 'strong' ELSE 'weak' END AS quadrant, round(ms, 4) AS ms, round(recall, 6) AS recall FROM s, m")
def k14_quadrants(spark, sf_dir):
    stats = det(spark, sf_dir).groupBy("engine").agg(F.avg("ms").alias("ms"), (F.count("payload") / F.count("*")).alias("recall"))
    return M.quadrants(stats).withColumns({"ms": F.round("ms", 4), "recall": F.round("recall", 6)})


_MATCH = f"""t AS (SELECT * FROM det WHERE engine = 'zxing'), d AS (SELECT * FROM det WHERE engine <> 'zxing'),
  c AS (SELECT d.image_id, d.engine, d.det_ix AS d, t.det_ix AS g, d.score, {iou_sql("d", "t")} AS o, d.payload IS NOT DISTINCT FROM t.payload AS same FROM d JOIN t ON d.image_id = t.image_id),
  l AS (SELECT image_id, engine, list({{'d': d, 'g': g, 'same': same}} ORDER BY score DESC, d, o DESC, g) AS b FROM c WHERE o >= 0.5 GROUP BY 1, 2),
  h AS (SELECT image_id, engine, unnest(list_reduce(b, lambda acc, x: CASE WHEN len(list_filter(acc.k, lambda y: y.d = x.d OR y.g = x.g)) > 0 THEN acc ELSE {{'k': list_append(acc.k, x)}} END, {{'k': b[1:0]}}).k) AS m FROM l),
  own AS (SELECT d.engine, coalesce(t.symbology, d.symbology) AS symbology, h.m.same AS same, h.m.g AS g FROM d JOIN (SELECT DISTINCT image_id FROM t) USING (image_id) LEFT JOIN h ON h.image_id = d.image_id AND h.engine = d.engine AND h.m.d = d.det_ix LEFT JOIN t ON t.image_id = d.image_id AND t.det_ix = h.m.g)"""
_SCORES = "tp, n - tp AS fp, t - tp AS fn, payload_correct, tp::DOUBLE / nullif(n, 0) AS p, tp::DOUBLE / nullif(t, 0) AS r"


def _rates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "tp", "fp", "fn", "payload_correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_ROUNDED = "tp, fp, fn, payload_correct, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0.0), 6) AS f1"


@query(f"{DET}, {_MATCH}, s AS (SELECT engine, count(*) AS n, count(g) AS tp, count(*) FILTER (same) AS payload_correct, (SELECT count(*) FROM t) AS t FROM own GROUP BY 1), z AS (SELECT engine, {_SCORES} FROM s) SELECT engine, {_ROUNDED} FROM z")
def k15_ground_truth(spark, sf_dir):
    d = det(spark, sf_dir)
    return _rates(M.ground_truth(d.filter("engine = 'zxing'"), d.filter("engine <> 'zxing'")), "engine")


@query(f"{DET}, {_MATCH}, s AS (SELECT engine, symbology, count(*) AS n, count(g) AS tp, count(*) FILTER (same) AS payload_correct FROM own GROUP BY 1, 2), w AS (SELECT symbology, count(*) AS t FROM t GROUP BY 1), f AS (SELECT engine, symbology, t FROM (SELECT DISTINCT engine FROM d), w), j AS (SELECT engine, symbology, coalesce(t, 0) AS t, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(payload_correct, 0) AS payload_correct FROM f FULL JOIN s USING (engine, symbology)), z AS (SELECT engine, symbology, {_SCORES} FROM j) SELECT engine, symbology, {_ROUNDED} FROM z")
def k15_by_symbology(spark, sf_dir):
    d = det(spark, sf_dir)
    return _rates(M.ground_truth(d.filter("engine = 'zxing'"), d.filter("engine <> 'zxing'"), by=("engine", "symbology")), "engine", "symbology")


@query(f"{DET} SELECT engine, round(avg(ms), 4) AS mean, {', '.join(f'round(quantile_cont(ms, {p / 100}), 4) AS p{p}' for p in (50, 95, 99))} FROM det GROUP BY 1")
def k16_latency(spark, sf_dir):
    return M.latency(det(spark, sf_dir)).select("engine", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query(f"{DET} SELECT engine, round(count(DISTINCT CASE WHEN payload IS NOT NULL THEN image_id END)::DOUBLE / (SELECT count(DISTINCT image_id) FROM det), 6) AS image_recall, count(*) AS detections, round(avg(ms), 4) AS mean_ms FROM det GROUP BY 1")
def k17_image_recall(spark, sf_dir):
    d = det(spark, sf_dir)
    return M.image_recall(d, d).withColumns({"image_recall": F.round("image_recall", 6), "mean_ms": F.round("mean_ms", 4)})


_SEEN = ("qr", "code_128", "data_matrix", "ean_13")


@query(f"{DET} SELECT engine, {', '.join(f"count(*) FILTER (symbology = '{s}') AS {s}" for s in _SEEN)} FROM det GROUP BY 1")
def k18_heatmap(spark, sf_dir):
    return M.heatmap(det(spark, sf_dir), list(_SEEN))


@query(ORACLE_SQL["h4_cluster_votes"].replace(", CAST(sum(k) AS BIGINT) AS detections", ""))
def k19_cluster_sizes(spark, sf_dir):
    return M.vote_histogram(det(spark, sf_dir)).select("vote_count", "clusters")


@query(f"{DET}, {_ATTEMPTS}, f AS (SELECT symbology, first(stage ORDER BY stage_ix) FILTER (payload IS NOT NULL) AS stage FROM t GROUP BY det_ix, symbology), c AS (SELECT symbology, stage, count(*) AS n FROM f WHERE stage IS NOT NULL GROUP BY 1, 2) SELECT symbology, stage, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY symbology), 6) AS share FROM c")
def k20_stage_share(spark, sf_dir):
    return M.stage_share(D.first_success(attempts(spark, sf_dir), ["det_ix", "symbology"])).withColumn("share", F.round("share", 6))


@query(f"{DET}, m AS (SELECT engine, CASE WHEN user_id % 2 = 0 THEN 'off' ELSE 'auto' END AS mode, payload FROM det), r AS (SELECT engine, 100.0::DOUBLE * count(payload) FILTER (mode = 'off') / count(*) FILTER (mode = 'off') AS a, 100.0::DOUBLE * count(payload) FILTER (mode = 'auto') / count(*) FILTER (mode = 'auto') AS b FROM m GROUP BY 1) SELECT engine, round(a, 6) AS off, round(b, 6) AS auto, round(a - b, 6) AS delta_pp FROM r")
def k21_mode_delta(spark, sf_dir):
    d = det(spark, sf_dir).withColumn("mode", F.when(F.col("user_id") % 2 == 0, "off").otherwise("auto"))
    return M.mode_delta(d).select("engine", *[F.round(c, 6).alias(c) for c in ("off", "auto", "delta_pp")])


@query(f"{DET}, t AS (SELECT engine, CAST(1 + det_ix % 8 AS INT) AS workers, 1000.0 * count(*) / sum(ms) AS images_per_s FROM det GROUP BY 1, 2), f AS (SELECT *, images_per_s / first_value(images_per_s) OVER (PARTITION BY engine ORDER BY workers) AS s FROM t) SELECT engine, workers, round(images_per_s, 4) AS images_per_s, round(s, 4) AS speedup, round(s / workers, 4) AS efficiency FROM f")
def k22_scaling(spark, sf_dir):
    t = det(spark, sf_dir).groupBy("engine", (1 + F.col("det_ix") % 8).cast("int").alias("workers")).agg((1000 * F.count("*") / F.sum("ms")).alias("images_per_s"))
    return M.scaling(t).select("engine", "workers", *[F.round(c, 4).alias(c) for c in ("images_per_s", "speedup", "efficiency")])


@query(ORACLE_SQL["e7_reconcile"].replace("SELECT det_ix, final AS symbology, decoder, CASE WHEN detector <> final THEN upper(detector) END AS detector_symbology FROM r", "SELECT detector AS detector_symbology, final AS symbology, count(*) AS n FROM r WHERE detector <> final GROUP BY 1, 2"))
def k23_mismatches(spark, sf_dir):
    d = det(spark, sf_dir).withColumns({"decoder": F.expr(_DECODER), "decoded": F.expr(_DECODED), "detector_symbology": F.col("symbology")})
    return M.mismatches(d.withColumn("symbology", D.reconciled(F.col("decoder"), F.col("decoded"), F.col("symbology"))))


@query(f"{DET}, k AS (SELECT DISTINCT engine IN ('native', 'zxing') AS p, image_id, CASE WHEN symbology = 'ean_13' THEN payload[1:12] ELSE payload END AS code FROM det WHERE payload IS NOT NULL), b AS (SELECT image_id, code, bool_or(p) AS planted, bool_or(NOT p) AS decoded FROM k GROUP BY 1, 2) SELECT image_id, count(*) FILTER (NOT planted) AS fabricated, count(*) FILTER (NOT decoded) AS missed, count(*) FILTER (decoded) AS n_decoded, count(*) FILTER (planted) AS n_planted FROM b GROUP BY 1")
def k24_fabrication(spark, sf_dir):
    d, p = det(spark, sf_dir), F.col("engine").isin("native", "zxing")
    return M.fabrication(d.filter(p), d.filter(~p))


@query(f"{DET}, {folded('det', 0.5)}, {MERGED}, m AS (SELECT * FROM merged WHERE vote_count >= 2) SELECT (SELECT count(DISTINCT image_id) FROM det) AS scans, (SELECT count(*) FROM m) AS detections, (SELECT count(payload) FROM m) AS decodes")
def n1_profile_sweep(spark, sf_dir):
    """Counts over a whole scan; images on which every engine breaks are left out."""
    images = recorded(spark, sf_dir)
    broken = images.select((-1 - F.col("image_id")).alias("image_id"), "width", "height", F.encode(F.lit("no JSON"), "UTF-8").alias("content"))
    return M.sweep(Scanner(engines=recorders(*ENGINES), consensus=2).scan(images.unionByName(broken)))
