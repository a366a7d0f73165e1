"""Corpus metrics over detections; each is one or two hash aggregations with partial sums before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fold import clustered
from ..functions.geometry import BOX, iou
from .consensus import cluster_votes, merge

CODE = ["image_id", "symbology", "payload"]


def images_with_code(det: DataFrame) -> DataFrame:
    return det.filter("payload is not null").agg(F.countDistinct("image_id").alias("images"))


def distinct_codes(det: DataFrame) -> DataFrame:
    return det.agg(F.countDistinct(F.sha2("payload", 256)).alias("codes"))


def yield_by_configuration(det: DataFrame, votes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Images with a code and distinct codes of each engine, and of the merged table at several thresholds from one clustering."""
    measure = [F.countDistinct(F.when(F.col("payload").isNotNull(), F.col("image_id"))).alias("images"), F.countDistinct("payload").alias("codes")]
    merged = merge(det, 1).select("image_id", "payload", F.explode(F.array(*[F.when(F.col("vote_count") >= n, F.lit("union" if n == 1 else f"consensus_{n}")) for n in votes])).alias("configuration"))
    return det.groupBy(F.col("engine").alias("configuration")).agg(*measure).unionByName(merged.filter("configuration is not null").groupBy("configuration").agg(*measure))


def yield_by_symbology(det: DataFrame, engines: list[str]) -> DataFrame:
    """Distinct payloads per symbology and engine, and over all engines."""
    counts = [F.countDistinct(F.when(F.col("engine") == e, F.col("payload"))).alias(e) for e in engines]
    return det.groupBy("symbology").agg(*counts, F.countDistinct("payload").alias("union"))


def exclusive(det: DataFrame) -> DataFrame:
    """Merged clusters of a single engine, by engine; those of two or more as "corroborated"."""
    who = F.when(F.col("vote_count") == 1, F.col("voted_by")[0]).otherwise("corroborated")
    return merge(det, 1).groupBy(who.alias("engine")).agg(F.count("*").alias("clusters"))


def engine_decodes(det: DataFrame) -> DataFrame:
    return det.groupBy("engine").agg(
        F.count("*").alias("n_detections"), F.count("payload").alias("n_decoded"), F.countDistinct("payload").alias("n_unique_payloads"),
        F.countDistinct(F.when(F.col("payload").isNotNull(), F.col("image_id"))).alias("n_decoded_images"), (F.count("payload") / F.count("*")).alias("decode_rate"),
    )


def decoded_clusters(det: DataFrame) -> DataFrame:
    """Histogram of votes over clusters of decoded rows only."""
    return cluster_votes(det.filter("payload is not null")).groupBy("vote_count").agg(F.count("*").alias("clusters"))


def read_clusters(det: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """Who read what in which cluster: the fold carries what the metrics need and no more."""
    return clustered(det.select("image_id", "engine", "engine_rank", "det_ix", *BOX, "score", "payload"), iou_threshold).select("image_id", "seed", "engine", "payload")


def payload_agreement(rows: DataFrame) -> DataFrame:
    """Of clustered rows: per cluster the most engines that agree on one payload, as a histogram."""
    each = rows.filter("payload is not null").groupBy("image_id", "seed", "payload").agg(F.countDistinct("engine").alias("n"))
    return each.groupBy("image_id", "seed").agg(F.max("n").alias("agreeing")).groupBy("agreeing").agg(F.count("*").alias("clusters"))


def payload_recall(det: DataFrame) -> DataFrame:
    """Share of all decoded codes that each engine has. The total is one row, summed once more from the per-code groups."""
    codes = det.filter("payload is not null").select("engine", *CODE).distinct()
    total = codes.select(*CODE).distinct().agg(F.count("*").alias("universe"))
    return codes.groupBy("engine").agg(F.count("*").alias("codes")).join(F.broadcast(total)).withColumn("recall", F.col("codes") / F.col("universe"))


def unique_decodes(det: DataFrame) -> DataFrame:
    """Codes that exactly one engine decoded, by engine."""
    one = det.filter("payload is not null").groupBy(*CODE).agg(F.min("engine").alias("engine"), F.max("engine").alias("other")).filter("engine = other")
    return one.groupBy("engine").agg(F.count("*").alias("codes"))


def lacking(det: DataFrame, engine: str, symbology: str) -> DataFrame:
    """(engine, image_id, payload) decodes of one symbology that ``engine`` lacks."""
    codes = det.filter((F.col("symbology") == symbology) & F.col("payload").isNotNull()).select("engine", "image_id", "payload").distinct()
    return codes.filter(F.col("engine") != engine).join(codes.filter(F.col("engine") == engine), ["image_id", "payload"], "left_anti")


def validated_recall(rows: DataFrame, engines: list[str], min_votes: int = 2) -> DataFrame:
    """Of clustered rows: payloads that at least ``min_votes`` engines read in a cluster, and how each engine did on them.

    The few engine names multiply the verified codes inside a projection; nothing is cross-joined.
    """
    if min_votes < 1:
        raise ValueError("min_votes must be at least 1")
    read = rows.filter("payload is not null").groupBy("image_id", "seed", "payload").agg(F.collect_set("engine").alias("who"))
    verified = read.filter(F.size("who") >= min_votes)
    seen = read.groupBy("image_id", "seed").agg(F.array_distinct(F.flatten(F.collect_list("who"))).alias("any"))
    each = verified.join(seen, ["image_id", "seed"]).withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
    right, read_ = F.array_contains("who", F.col("engine")), F.array_contains("any", F.col("engine"))
    out = each.groupBy("engine").agg(F.count("*").alias("universe"), F.count_if(right).alias("correct"), F.count_if(~right & read_).alias("disagreed"), F.count_if(~read_).alias("missed"))
    return out.withColumn("correctness", F.col("correct") / F.col("universe")).withColumn("disagreement", F.when(F.col("correct") + F.col("disagreed") > 0, F.col("disagreed") / (F.col("correct") + F.col("disagreed"))))


def greedy_coverage(det: DataFrame, engines: list[str]) -> DataFrame:
    """Engines in the order of their largest marginal gain of codes.

    Codes are reduced to counts per set of engines (a bit mask: at most 2^engines rows); the loop over engines folds those counts.
    """
    bit = reduce(lambda a, e: a.when(F.col("engine") == e, F.lit(1 << engines.index(e))), engines[1:], F.when(F.col("engine") == engines[0], F.lit(1)))
    masks = det.filter("payload is not null").groupBy(*CODE).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    counts = {r["mask"]: r["n"] for r in masks.collect()}
    rows, covered, left = [], 0, list(enumerate(engines))
    while left:
        gain, _, (i, name) = max((sum(n for m, n in counts.items() if m >> i & 1 and not m & covered), -i, (i, e)) for i, e in left)
        covered |= 1 << i
        left.remove((i, name))
        rows.append((len(rows) + 1, name, gain, sum(r[2] for r in rows) + gain))
    return det.sparkSession.createDataFrame(rows, "step int, engine string, gained bigint, covered bigint")


def quadrants(stats: DataFrame) -> DataFrame:
    """``(engine, ms, recall)`` split at both medians."""
    medians = stats.agg(F.median("ms").alias("m"), F.median("recall").alias("r"))
    label = F.concat(F.when(F.col("ms") <= F.col("m"), "fast").otherwise("slow"), F.lit("_"), F.when(F.col("recall") >= F.col("r"), "strong").otherwise("weak"))
    return stats.join(F.broadcast(medians)).select("engine", "ms", "recall", label.alias("quadrant"))


def ground_truth(truth: DataFrame, det: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("engine",)) -> DataFrame:
    """Precision, recall and F1 per engine: boxes take the free true box of largest overlap, best score first, over images with truth. With ``by`` ("engine", "symbology") a true
    box counts under its own symbology, a detection that takes none under the one it claims.

    Candidates come from an equi-join on the image; the one-to-one choice is a fold over an image's candidates.
    """
    t = truth.select(F.col("image_id").alias("ti"), F.col("det_ix").alias("gt"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")], F.col("payload").alias("t_payload"))
    a, b = ({c: F.col(p + c) for c in ("x1", "y1", "x2", "y2")} for p in ("", "t_"))
    near = det.join(t, F.col("image_id") == F.col("ti")).withColumn("o", iou(a, b)).filter(F.col("o") >= threshold)
    item = F.struct((-F.col("score")).alias("s"), F.col("det_ix").alias("d"), (-F.col("o")).alias("o"), F.col("gt").alias("g"), F.col("payload").eqNullSafe(F.col("t_payload")).alias("same"))
    chosen = near.groupBy("image_id", "engine").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "array<struct<d:int,g:int,same:boolean>>"
    pick = lambda k, x: F.when(F.exists(k, lambda y: (y["d"] == x["d"]) | (y["g"] == x["g"])), k).otherwise(F.concat(k, F.array(F.struct(x["d"].alias("d"), x["g"].alias("g"), x["same"].alias("same")))))
    hit = chosen.withColumn("k", F.explode(F.aggregate("all", F.array().cast(kind), pick))).select("image_id", "engine", "k.d", "k.g", "k.same")
    own = det.join(truth.select("image_id").distinct(), "image_id", "left_semi").select("image_id", "engine", F.col("det_ix").alias("d"), "symbology")
    marked = own.join(hit, ["image_id", "engine", "d"], "left").join(truth.select("image_id", F.col("det_ix").alias("g"), F.col("symbology").alias("true_symbology")), ["image_id", "g"], "left")
    marked = marked.withColumn("symbology", F.coalesce("true_symbology", "symbology"))
    seen = marked.groupBy(*by).agg(F.count("*").alias("n"), F.count("g").alias("tp"), F.count_if("same").alias("payload_correct"))
    engines = det.select("engine").distinct()
    rest = [c for c in by if c != "engine"]
    total = truth.groupBy(*rest).agg(F.count("*").alias("t"))
    # a handful of engines beside a handful of symbologies
    frame = engines.join(F.broadcast(total)) if rest else seen.select("engine").join(F.broadcast(total))
    out = frame.join(seen, list(by), "full" if rest else "inner").fillna(0, ["t", "n", "tp", "payload_correct"])
    p, r = F.try_divide(F.col("tp"), F.col("n")), F.try_divide(F.col("tp"), F.col("t"))
    return out.select(*by, "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), "payload_correct", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


#: One image's true codes as a JSON line.
TRUTH = "image_id bigint, codes array<struct<x1:double,y1:double,x2:double,y2:double,symbology:string,payload:string>>"


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from JSON lines of :data:`TRUTH`, a row a code; a line that doesn't fit fails the job."""
    codes = spark.read.schema(TRUTH).option("mode", "FAILFAST").json(path)
    return codes.select("image_id", F.posexplode("codes").alias("det_ix", "c")).select("image_id", "det_ix", "c.*")


def sweep(results: DataFrame) -> DataFrame:
    """Scans and decodes of a scan's results, images without a single engine that ran left out."""
    whole = results.filter(F.size("raw") > F.coalesce(F.size("errors"), F.lit(0))) if "errors" in results.columns else results
    return whole.agg(F.count("*").alias("scans"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"), F.coalesce(F.sum(F.size(F.filter("detections", lambda d: d["payload"].isNotNull()))), F.lit(0)).cast("long").alias("decodes"))


def latency(rows: DataFrame) -> DataFrame:
    """``(engine, ms)``: mean and exact percentiles."""
    return rows.groupBy("engine").agg(F.avg("ms").alias("mean"), *[F.percentile("ms", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)])


def image_recall(det: DataFrame, images: DataFrame) -> DataFrame:
    """Per engine: share of images with a code, detections, mean latency ``ms``."""
    total = images.agg(F.countDistinct("image_id").alias("images"))
    each = det.groupBy("engine").agg(F.countDistinct(F.when(F.col("payload").isNotNull(), F.col("image_id"))).alias("hit"), F.count("*").alias("detections"), F.avg("ms").alias("mean_ms"))
    return each.join(F.broadcast(total)).select("engine", (F.col("hit") / F.col("images")).alias("image_recall"), "detections", "mean_ms")


def heatmap(det: DataFrame, symbologies: list[str]) -> DataFrame:
    return det.groupBy("engine").agg(*[F.count_if(F.col("symbology") == s).alias(s) for s in symbologies])


def vote_histogram(det: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    return cluster_votes(det, iou_threshold).groupBy("vote_count").agg(F.count("*").alias("clusters"), F.sum("source_count").alias("detections"))


def stage_share(reads: DataFrame) -> DataFrame:
    """``(symbology, stage)``: payloads and their share within the symbology."""
    n = reads.filter("payload is not null").groupBy("symbology", "stage").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("symbology")))


def mode_delta(rows: DataFrame) -> DataFrame:
    """``(engine, mode, payload)``: decode rates with mode off and auto, and their difference in percentage points."""
    rate = lambda m: 100 * F.count_if((F.col("mode") == m) & F.col("payload").isNotNull()) / F.count_if(F.col("mode") == m)
    return rows.groupBy("engine").agg(rate("off").alias("off"), rate("auto").alias("auto")).withColumn("delta_pp", F.col("off") - F.col("auto"))


def scaling(rows: DataFrame) -> DataFrame:
    """``(engine, workers, images_per_s)``: speedup against the fewest workers, and efficiency."""
    base = F.first_value("images_per_s").over(W.partitionBy("engine").orderBy("workers"))
    return rows.withColumn("speedup", F.col("images_per_s") / base).withColumn("efficiency", F.col("speedup") / F.col("workers"))


def mismatches(rows: DataFrame) -> DataFrame:
    """Detector against final symbology, where they differ."""
    return rows.filter("detector_symbology <> symbology").groupBy("detector_symbology", "symbology").agg(F.count("*").alias("n"))


def fabrication(planted: DataFrame, decoded: DataFrame) -> DataFrame:
    """Per image: decoded payloads that nobody planted, planted ones that nobody read, distinct decoded. EAN-13 compares by 12 digits."""
    key = F.when(F.col("symbology") == "ean_13", F.substring("payload", 1, 12)).otherwise(F.col("payload"))
    one = lambda df: df.filter("payload is not null").select("image_id", key.alias("code")).distinct()
    p, d = one(planted).withColumn("planted", F.lit(1)), one(decoded).withColumn("decoded", F.lit(1))
    both = p.join(d, ["image_id", "code"], "full")
    return both.groupBy("image_id").agg(F.count_if(F.col("planted").isNull()).alias("fabricated"), F.count_if(F.col("decoded").isNull()).alias("missed"), F.count("decoded").alias("n_decoded"), F.count("planted").alias("n_planted"))
