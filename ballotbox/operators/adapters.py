"""What engines report, as tables, to detections: formats mapped, boxes from corners, degenerate and empty reads dropped, each engine's own order.

All are projections, filters, one broadcast of the format table, and one row number within an image.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import bounds, flipped
from ..schema import DETECTIONS, ENGINES, dim_decoder_format, requestable
from .decode import mapped_formats

#: What to ask for instead of symbologies that an engine only reports.
HINTS = {
    ("zxing", "other_1d"): "other_1d is detect-only: name the linear symbologies one by one",
    ("apple_vision", "other_1d"): "other_1d is detect-only: name the linear symbologies one by one",
    ("apple_vision", "upc_a"): "UPC-A is reported as EAN-13 with a leading zero: ask for ean_13",
}


def requested(decoder: str, formats: Iterable[str] | None) -> list[str] | None:
    """The decoder's own names for ``formats``, to be handed to it; None asks for all. Symbologies that can't be asked for raise, with a hint."""
    if formats is None:
        return None
    if isinstance(formats, str):
        raise TypeError("formats must be symbologies, not one string")
    names, wanted = requestable(decoder), frozenset(formats)
    if unsupported := sorted(wanted - names.keys()):
        hints = [HINTS[decoder, s] for s in unsupported if (decoder, s) in HINTS]
        raise ValueError(f"{decoder} can't be asked for {', '.join(unsupported)}" + "".join(f"; {h}" for h in hints))
    return [x for s in names if s in wanted for x in names[s]]


def restricted(raw: DataFrame, decoder: str, formats: Iterable[str] | None) -> DataFrame:
    """``raw(raw_format, ...)`` of the asked formats alone; over a Parquet table the scan gets the filter."""
    names = requested(decoder, formats)
    return raw if names is None else raw.filter(F.col("raw_format").isin(names))


def _told(rows: DataFrame, engine: str, order: list[Column], extras: Column) -> DataFrame:
    """Detections in the engine's order."""
    place = F.row_number().over(W.partitionBy("image_id").orderBy(*order)) - 1
    rows = rows.withColumns({"engine": F.lit(engine), "engine_rank": F.lit(ENGINES.index(engine)), "det_ix": place.cast("int"), "extras": extras})
    return rows.select(*[F.col(x.split()[0]).cast(x.split(maxsplit=1)[1]) for x in DETECTIONS.split(", ")])


def _boxed(rows: DataFrame) -> DataFrame:
    """With the box of ``polygon``; without area, no row."""
    return rows.withColumns(bounds(F.col("polygon"))).filter("x2 > x1 and y2 > y1")


def _present(pairs: dict[str, Column]) -> Column:
    every = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(every, lambda p: p["value"].isNotNull()))


def zxing(raw: DataFrame, formats: Iterable[str] | None = None) -> DataFrame:
    """``raw(image_id, read_ix, valid, raw_format, text, polygon, identifier, ec_level)``, corners from the top left on, clockwise: valid reads of known
    formats, all of score 1, in the decoder's order."""
    rows = restricted(raw.filter("valid"), "zxing", formats).withColumn("decoder", F.lit("zxing"))
    rows = mapped_formats(rows, dim_decoder_format(raw.sparkSession), drop=True)
    rows = _boxed(rows).withColumns({"symbology": F.col("mapped"), "payload": F.col("text"), "score": F.lit(1.0)})
    return _told(rows, "zxing", [F.col("read_ix")], _present({"symbology_identifier": F.col("identifier"), "ec_level": F.when(F.col("ec_level") != "", F.col("ec_level"))}))


def wechat(raw: DataFrame) -> DataFrame:
    """``raw(image_id, texts array<string>, points array<polygon>)``, one row an image: texts and points in step (lists of different lengths fail that image's row),
    QR alone, empty texts and other than four corners dropped, score 1, the largest box first."""
    in_step = F.when(F.size("texts") == F.size("points"), F.arrays_zip("texts", "points")).otherwise(F.raise_error(F.lit("as many texts as polygons are wanted")))
    rows = raw.select("image_id", F.posexplode(in_step).alias("read_ix", "r")).select("image_id", "read_ix", F.col("r.texts").alias("payload"), F.col("r.points").alias("polygon"))
    rows = _boxed(rows.filter("payload <> '' and size(polygon) = 4")).withColumns({"symbology": F.lit("qr"), "score": F.lit(1.0)})
    return _told(rows, "wechat", by_area("read_ix"), F.create_map().cast("map<string,string>"))


def by_area(tie: str) -> list[Column]:
    """The largest box first."""
    return [((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).desc(), F.col(tie)]


def apple_vision(raw: DataFrame, formats: Iterable[str] | None = None) -> DataFrame:
    """``raw(image_id, read_ix, raw_format, payload, confidence, corners, width, height)``, corners as shares of the image from its bottom left: pixels from the top left,
    reads without payload or of unknown formats dropped, the most confident first."""
    rows = restricted(raw.filter("payload <> ''"), "apple_vision", formats).withColumn("decoder", F.lit("apple_vision"))
    rows = mapped_formats(rows, dim_decoder_format(raw.sparkSession), drop=True)

    def pixel(p: Column) -> Column:
        x, y = flipped(p["x"], p["y"], F.col("width"), F.col("height"))
        return F.struct(x.alias("x"), y.alias("y"))

    rows = _boxed(rows.withColumn("polygon", F.transform("corners", pixel))).withColumns({"symbology": F.col("mapped"), "score": F.col("confidence")})
    return _told(rows, "apple_vision", [F.col("score").desc(), F.col("read_ix")], F.create_map().cast("map<string,string>"))


