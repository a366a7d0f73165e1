"""What the operators share: staged tables, size-checked broadcasts, connected components, what Python workers hold."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of a broadcast side, as rows times the width that ``width`` states.
BROADCAST_BYTES = 32 << 20

#: Set while a table is staged: the write's shuffle files, which have no reader after it, are deleted at its end, and Python workers get few texts at once.
_WHILE_STAGED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

#: ASCII white space, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder set on the context. Where neither
    is set, the warehouse on a cluster, and on a single machine (a local master) a folder of our own."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not told:
        told = f"file:/tmp/checkpoints/{context.applicationId}" if context.master.split("[")[0] == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/staged-{context.applicationId}"
    return told.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, so an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_STAGED}
    for k, v in _WHILE_STAGED.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    schema = df.schema
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def discard(staged: DataFrame, part: str = "") -> None:
    """Delete the table of a DataFrame from :func:`stage`, or one partition of it. Only for what nothing still to be run reads."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{staged.staged_at}/{part}" if part else staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch(list):
    """Staged tables of one operator, all deleted by ``clear`` when its result is staged."""

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        self.append(out)
        return out

    def clear(self) -> None:
        for x in self:
            discard(x)
        super().clear()


def width(schema: T.StructType) -> int:
    """Bytes of a row in a broadcast relation: a row's own overhead, and what its columns of fixed or short values take."""
    kinds = {T.StringType: 120, T.BinaryType: 48}
    if any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) for f in schema):
        raise TypeError("rows without a bound on their width are not broadcast")
    return 40 + sum(kinds.get(type(f.dataType), 8) for f in schema)


def small(staged: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table (keys, ids, digests) may be broadcast; counting it is cheap."""
    limit = most // width(staged.schema)
    return staged.limit(limit + 1).count() <= limit


def sized(staged: DataFrame) -> DataFrame:
    """The side of a join: broadcast if :func:`small`; beyond, the same join shuffles both sides, and Spark may split what is skewed."""
    return F.broadcast(staged) if small(staged) else staged


def keep_matching(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in the staged ``keys`` (one distinct column of that name, nulls match)."""
    return rows.join(sized(keys.withColumnRenamed(key, "__key")), F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def map_rows(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` over a table with a long ``doc_id``, which reaches ``run`` as nullable integers: pandas alone would make floats of a batch that holds a
    null, and large ids would no longer be exact."""
    sent = df.withColumns({"doc_id": F.coalesce("doc_id", F.lit(0)), "__no_id": F.col("doc_id").isNull()})

    def run_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                none = pdf.pop("__no_id").to_numpy(bool)
                pdf["doc_id"] = pd.arrays.IntegerArray(pdf["doc_id"].to_numpy(np.int64), none)
                yield pdf

        return run(whole())

    return sent.mapInPandas(run_whole, schema)


def framed(rows: list[tuple], columns: list[str], at: int = 0) -> pd.DataFrame:
    """A frame of tuples whose ``at``-th value is an id or None."""
    out = pd.DataFrame(rows, columns=columns)
    out[columns[at]] = pd.array([r[at] for r in rows], dtype="Int64")
    return out


def ids_of(pdf: pd.DataFrame) -> list[int | None]:
    return [None if x is pd.NA else int(x) for x in pdf["doc_id"].array]


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """Called at the start of an operator's task in a Python worker. Workers are used again by other operators: tables that those left behind are
    dropped here, so a worker holds those of one operator at a time, and what earlier tasks have freed goes back to the system. ``drop`` empties the caller's."""
    for x in [x for x in _HELD if x != name]:
        _HELD.pop(x)()
    _HELD[name] = drop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, then the C library's heap. From then on blocks of 64 KB or more are mapped one by one, so that they go back when freed."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 1 << 16)  # M_MMAP_THRESHOLD
        library.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def components(edges: DataFrame | list[DataFrame], most_rounds: int = 60) -> DataFrame:
    """Connected components of the graph ``edges(a long, b long)`` as staged ``(node, comp)``, comp the least node.

    Alternates large-star and small-star steps; each round is staged, nothing is collected but two
    checksums. The least neighbours are staged before they are joined, so that Spark may split a hub's edges.
    Isolated nodes don't appear. Raises if ``most_rounds`` isn't enough.
    """
    own, scratch = edges if isinstance(edges, list) else [edges], Scratch()
    every = own[0].select("a", "b")
    for x in own[1:]:
        every = every.unionByName(x.select("a", "b"))
    e = scratch.stage(every.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or (mark["n"], mark["s"]) == seen:
            out = stage(e.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("comp")).distinct(), "components")
            scratch.clear()
            return out
        seen = (mark["n"], mark["s"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = scratch.stage(both.join(sized(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        down = scratch.stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        step = large.join(sized(down), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        following = stage(step.select("x.u", "x.v").filter("u <> v").distinct(), "edges")
        scratch.clear()
        scratch.append(following)
        e = following
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
