"""Content-addressed web archive.

``archive`` stores each distinct payload once, under its SHA-256, in a table of blobs, and the exact header bytes of every
WARC record in a table of headers. ``read_records`` joins the two back into whole records and verifies each
blob against its digest. ``export_warc`` writes the records as WARC/1.1 files, ``import_warc`` parses such files.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest id is the response and the others
revisit it; smaller payloads are always responses. Defined results: a null payload is empty, a null url an empty
target; null ids come last; of repeated rows (same id and payload) one is the response and the others revisit
it; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, shared_dir, small, stage

LEAST = 100
EPOCH = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    path: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("page_id long, copy int, digest binary, record_type string, refers_to long, header binary").parquet(f"{self.path}/headers")

    def blobs(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("digest binary, payload binary").parquet(f"{self.path}/blobs")


def _header(date: str) -> Column:
    """WARC header lines of one record, then for both kinds the HTTP header block that the record keeps."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    hexed = F.lower(F.hex("digest"))
    ident = lambda page, copy: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), copy.cast("string"), F.lit(">"))
    block = F.length(http) + F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    revisit = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), ident(F.col("refers_to"), F.lit(1)), F.lit("\r\n"))
    return F.encode(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), ident(F.col("page_id"), F.col("copy")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), hexed, F.lit("\r\n"), F.when(F.col("record_type") == "revisit", revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"), http,
    ), "UTF-8")


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = EPOCH) -> Archive:
    """Write ``pages`` as a content-addressed archive below ``path`` (default: the shared folder)."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    raw = F.col(payload_col)
    payload = F.coalesce(raw if dict(pages.dtypes)[payload_col] == "binary" else F.encode(raw, "UTF-8"), F.lit(b""))
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    slim = full.select("page_id", "url", "digest", F.length("payload").cast("long").alias("payload_bytes"))
    # payloads stay behind: only ids, urls and digests are shuffled to find the responses
    numbered = slim.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
    several = slim.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"), F.min("payload_bytes").alias("b")).filter("n > 1")
    # staged and counted: beyond the bound both sides of the joins below are shuffled, and Spark may split a digest that very many records share
    several = stage(several.select(F.col("digest").alias("d"), "least", "b"), "warc-several")
    few = small(several)
    again = several.filter(F.col("b") >= least).select("d", "least")
    again = F.broadcast(again) if few else again
    answer = F.col("d").isNull() | (F.col("page_id").eqNullSafe(F.col("least")) & (F.col("copy") == 1))
    typed = numbered.join(again, F.col("digest") == F.col("d"), "left").withColumn("record_type", F.when(answer, "response").otherwise("revisit")).withColumn("refers_to", F.when(~answer, F.col("least")))
    typed.select("page_id", "copy", "digest", "record_type", "refers_to", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # each digest once: of digests with several records, all rows but the response's stay behind
    firsts = several.select("d", "least")
    met = full.select("page_id", "digest", "payload").join(F.broadcast(firsts) if few else firsts, F.col("digest") == F.col("d"), "left")
    once = met.filter(F.col("d").isNull() | F.col("page_id").eqNullSafe(F.col("least")))
    # repeated rows are told by the headers: only then is a further step needed
    if not Archive(path).headers(spark).filter("copy > 1").isEmpty():
        once = once.dropDuplicates(["digest"])
    once.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/blobs")
    discard(several)
    return Archive(path)


def read_records(spark: SparkSession, from_: Archive) -> DataFrame:
    """Whole records: page_id, copy, header, payload (of the response where the record revisits) and ``record``, the exact bytes
    as a WARC file holds them. A blob that doesn't match its digest raises."""
    blobs = from_.blobs(spark).select("digest", F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest"))).alias("payload"))
    revisit = F.col("record_type") == "revisit"
    return from_.headers(spark).join(blobs, "digest").select("page_id", "copy", "header", "payload", F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """Fields read from the records' own bytes, as a reader of a WARC file would: the header up to the first empty line, a block of the stated length, the payload
    behind the block's HTTP header. A record of another length, or whose payload doesn't match its stated digest, raises. Payload size and digest are
    those of the full payload, which for a revisit is that of the record it refers to (column ``payload``)."""
    # one character a byte, so places in the text are places in the bytes
    plain = lambda c: F.decode(c, "ISO-8859-1")
    parts = records.withColumn("__end", F.instr(plain(F.col("record")), "\r\n\r\n"))
    parts = parts.withColumn("__head", F.decode(F.substring("record", F.lit(1), F.col("__end") - 1), "UTF-8"))
    field = lambda name: F.regexp_extract(F.col("__head"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    parts = parts.withColumn("__length", field("Content-Length").cast("int"))
    whole = F.col("__end") + 3 + F.col("__length") + 4 == F.length("record")
    parts = parts.withColumn("__block", F.when(whole, F.substring("record", F.col("__end") + 4, F.col("__length"))).otherwise(F.raise_error(F.lit("a record of another length than it states"))))
    own = F.substring("__block", F.instr(plain(F.col("__block")), "\r\n\r\n") + 4, F.col("__length"))
    parts = parts.withColumn("__payload", F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(own))
    stated = F.regexp_extract(field("WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1)
    refers = F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+):", 1)
    return parts.select(
        "page_id",
        F.length("__payload").cast("long").alias("payload_bytes"),
        F.when(F.sha2("__payload", 256) == stated, stated).otherwise(F.raise_error(F.lit("a payload does not match its digest"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        F.length("record").cast("long").alias("record_bytes"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """WARC files: each record's bytes, closed by the two line ends that also part records."""
    body = F.expr("cast(substring(record, 1, length(record) - 4) as string)")
    records.select(body.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Parse WARC files: record_type, record_id, target_uri, refers_to, payload_digest, payload (null of a revisit).

    A file is read whole by one task: keep files at some 100 MB, as writers of archives do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                out, at = [], 0
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at)
                    fields = dict(x.split(": ", 1) for x in content[at:end].decode().split("\r\n")[1:])
                    block = content[end + 4 : end + 4 + int(fields["Content-Length"])]
                    body = block.partition(b"\r\n\r\n")[2]
                    kind = fields["WARC-Type"]
                    out.append((kind, fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), fields.get("WARC-Payload-Digest"), None if kind == "revisit" else body))
                    at = end + 4 + len(block) + 4
                yield pd.DataFrame(out, columns=["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary")
