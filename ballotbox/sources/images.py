"""Image files as rows: formats by magic bytes, sizes from headers, the error envelope, preprocessing, and models over images."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidImage
from ..functions.geometry import LONGEST
from ..operators.postprocess import family, stated
from .pixels import BRANDS, MAGIC, content_of, decode, header_size, kind_of, ppm, rgb, size_checked, to_ppm

def image_format(content: Column) -> Column:
    """The format by leading bytes, null if it isn't on the list."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, brands in BRANDS.items():
        out = out.when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin([b.hex().upper() for b in brands]), name)
    for name, heads in MAGIC.items():
        for h in heads:
            out = out.when(head.startswith(h.hex().upper()), name)
    return out


def _number(content: Column, at: int, n: int, little: bool) -> Column:
    parts = [F.conv(F.hex(F.substring(content, at + i, 1)), 16, 10).cast("int") * (1 << 8 * (i if little else n - 1 - i)) for i in range(n)]
    return sum(parts[1:], parts[0])


def image_size(content: Column, kind: Column) -> tuple[Column, Column]:
    """Width and height from the headers of png, gif and bmp files; null for others."""
    w = F.when(kind == "png", _number(content, 17, 4, False)).when(kind == "gif", _number(content, 7, 2, True)).when(kind == "bmp", _number(content, 19, 4, True))
    h = F.when(kind == "png", _number(content, 21, 4, False)).when(kind == "gif", _number(content, 9, 2, True)).when(kind == "bmp", F.abs(_number(content, 23, 4, True)))
    return w, h


def checked(rows: DataFrame) -> DataFrame:
    """``rows(content, ...)`` with format, width, height and ``error struct<type,message>``, null where the input is usable. Nothing is raised."""
    kind = image_format(F.col("content"))
    w, h = image_size(F.col("content"), F.col("format"))
    rows = rows.withColumn("format", kind).withColumn("width", w).withColumn("height", h)
    message = F.when(F.col("content").isNull(), "no content").when(F.col("format").isNull(), "not an image of a known format").when((F.col("width") < 1) | (F.col("height") < 1), "an image without pixels")
    return rows.withColumn("error", F.when(message.isNotNull(), F.struct(F.lit("InvalidImage").alias("type"), message.alias("message"))))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return checked(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels (BGR) of the formats that the JVM reads: (origin, height, width, nChannels, mode, data)."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def sampled(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` files by the hash of path and seed, the same on every run; all of them for n < 1."""
    return files if n < 1 else files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)


def probed(rows: DataFrame, decoded: bool = False) -> DataFrame:
    """Like :func:`checked` for every format whose header this package reads, bombs told apart; with ``decoded`` the pixels are read too, so a file that is cut short or
    has no reader is told. Nothing is raised: what is wrong stands in ``error``."""

    @F.pandas_udf("format string, width int, height int, type string, message string")
    def probe(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_probe(c, decoded) for c in contents], columns=["format", "width", "height", "type", "message"]).astype({"width": "Int32", "height": "Int32"})

    rows = rows.withColumn("__p", probe("content"))
    error = F.when(F.col("__p.type").isNotNull(), F.struct("__p.type", "__p.message"))
    return rows.withColumns({"format": F.col("__p.format"), "width": F.col("__p.width"), "height": F.col("__p.height"), "error": error}).drop("__p")


def _probe(content: bytes | None, decoded: bool) -> tuple:
    kind, size = kind_of(bytes(content)) if content else None, (None, None)
    try:
        if not content:
            raise InvalidImage("no content")
        if kind is None:
            raise InvalidImage("not an image of a known format")
        try:
            size = header_size(bytes(content), kind) or size
        except InvalidImage:
            raise
        except Exception as e:  # noqa: BLE001  a header may be cut anywhere
            raise InvalidImage(f"a {kind} header that can't be read: {type(e).__name__}") from e
        if size[0] is not None:
            size_checked(*size)
        if decoded:
            h, w = decode(content).shape[:2]
            size = (w, h)
        return kind, *size, None, None
    except InvalidImage as e:
        return kind, *size, type(e).__name__, str(e)


def table_of(spark: SparkSession, inputs: Iterable) -> DataFrame:
    """(image_id, path, content, format, width, height, error) of inputs of any kind (paths, bytes, binary streams, arrays), in their order. The driver reads them: for files of a
    whole corpus use :func:`read_files`."""
    rows = []
    for i, x in enumerate(inputs):
        try:
            rows.append((i, os.fspath(x) if isinstance(x, str | os.PathLike) else None, content_of(x), None))
        except InvalidImage as e:
            rows.append((i, os.fspath(x) if isinstance(x, str | os.PathLike) else None, None, str(e)))
    out = probed(spark.createDataFrame(rows, "image_id bigint, path string, content binary, said string"))
    told = F.when(F.col("said").isNotNull(), F.struct(F.lit(InvalidImage.__name__).alias("type"), F.col("said").alias("message"))).otherwise(F.col("error"))
    return out.withColumn("error", told).drop("said")


def write_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    """A scan's results: ``parquet`` or ``json`` as they are, ``text`` one line a detection."""
    if kind == "text":
        lines(results).write.text(path)
    else:
        results.write.format(kind).save(path)


def lines(results: DataFrame) -> DataFrame:
    """``symbology score [x1, y1, x2, y2] payload`` of each detection."""
    d = results.select("image_id", F.posexplode("detections").alias("i", "d")).select("image_id", "i", "d.*")
    return d.select(F.format_string("%s %.3f [%.1f, %.1f, %.1f, %.1f] %s", "symbology", "score", "x1", "y1", "x2", "y2", F.coalesce("payload", F.lit("-"))).alias("value"))


parse_ppm = ppm


def bgr(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels[:, :, ::-1])


def autocontrast(pixels: np.ndarray) -> np.ndarray:
    """Each channel stretched to 0..255; flat channels stay."""
    low, high = pixels.min((0, 1)).astype(np.float64), pixels.max((0, 1)).astype(np.float64)
    span = np.where(high > low, high - low, 1)
    out = np.clip((pixels - low) * 255 / span, 0, 255).astype(np.uint8)
    return np.where(high > low, out, pixels)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = pixels.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None, None], np.clip(x - x0, 0, 1)[None, :, None]
    p = pixels.astype(np.float32)
    top, low = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


#: Weights of longer rows are not kept.
LONG = 1 << 16


@lru_cache(4)
def _taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tap and each of ``m`` pixels made of ``n``: the source pixel and its weight. Images of a size mostly come together, so a few are kept."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    first = np.maximum(0, (centre - 3 * wide + 0.5).astype(int))
    end = np.minimum(n, (centre + 3 * wide + 0.5).astype(int))
    at = first[:, None] + np.arange((end - first).max())
    x = (at - centre[:, None] + 0.5) / wide
    weight = np.where((at < end[:, None]) & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0)
    weight /= weight.sum(1, keepdims=True)
    return np.ascontiguousarray(np.minimum(at, n - 1).T), np.ascontiguousarray(weight.T.astype(np.float32))


def shrunk(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos filter of three lobes over source pixels, columns first, 8 bits after each pass."""

    def rows(p: np.ndarray, m: int) -> np.ndarray:
        at, weight = (_taps if len(p) <= LONG else _taps.__wrapped__)(len(p), m)
        flat = np.ascontiguousarray(p).reshape(len(p), -1)
        out = np.zeros((m, flat.shape[1]), np.float32)
        for own, w in zip(at, weight, strict=True):
            out += flat.take(own, 0) * w[:, None]
        return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape(m, *p.shape[1:])

    across = rows(pixels.swapaxes(0, 1), width).swapaxes(0, 1) if width != pixels.shape[1] else pixels
    return rows(across, height) if height != pixels.shape[0] else across


def preprocessed(content: bytes, longest: int = LONGEST) -> tuple[bytes, float, float]:
    """An image downscaled to ``longest`` pixels and autocontrasted, as PPM, and the factors of width and height back to the original."""
    pixels = decode(content)
    h, w = pixels.shape[:2]
    nw, nh = w, h
    if max(w, h) > longest:
        ratio = longest / max(w, h)
        nw, nh = max(1, int(w * ratio)), max(1, int(h * ratio))
    return to_ppm(autocontrast(shrunk(pixels, nw, nh))), w / nw, h / nh


def letterboxed(pixels: np.ndarray, size: int = 640) -> tuple[np.ndarray, float]:
    """(1, 3, size, size) float32 in 0..1, the image at the top left over grey 114, and the ratio."""
    h, w = pixels.shape[:2]
    ratio = min(size / w, size / h)
    nw, nh = max(1, int(w * ratio)), max(1, int(h * ratio))
    out = np.full((size, size, 3), 114, np.float32)
    out[:nh, :nw] = resized(rgb(pixels), nw, nh)
    return np.ascontiguousarray((out / 255).transpose(2, 0, 1)[None].astype(np.float32)), ratio


def anchor_rows(outputs: list[np.ndarray], arch: str | None) -> np.ndarray:
    """One row per anchor from a model's output tensors: RT-DETR's boxes before its logits, YOLO11's features as columns."""
    layout = family(arch)
    wanted = 2 if layout == "rtdetr" else 1
    if len(outputs) < wanted or any(x.ndim != 3 or x.shape[0] != 1 for x in outputs[:wanted]):
        raise ValueError(f"{layout} wants {wanted} tensors of one image each (1, rows, features); got {[x.shape for x in outputs]}")
    if layout == "rtdetr":
        logits, boxes = outputs[:2]
        if logits.shape[1] != boxes.shape[1] or boxes.shape[2] != 4:
            raise ValueError(f"logits {logits.shape} and boxes {boxes.shape} don't belong together")
        return np.concatenate([boxes[0], logits[0]], 1)
    return outputs[0][0].T if layout == "yolo11" else outputs[0][0]


def infer(images: DataFrame, model: str, arch: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """``images(image_id, content)`` through an ONNX file to ``anchors(image_id, anchor_ix, feat, ratio, width, height)``. Images that can't be read give none.

    The session is built once per Python worker; the input's name is the session's own, and so is ``arch`` where none is given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .models import providers, session

        own = session(model, tuple(providers(wanted)))
        name = own.get_inputs()[0].name
        layout = arch or stated(dict(own.get_modelmeta().custom_metadata_map), "arch")
        for pdf in batches:
            for image_id, content in zip(pdf["image_id"], pdf["content"], strict=True):
                try:
                    pixels = decode(content)
                except InvalidImage:
                    continue
                tensor, ratio = letterboxed(pixels)
                rows = anchor_rows(own.run(None, {name: tensor}), layout)
                yield pd.DataFrame({"image_id": image_id, "anchor_ix": np.arange(len(rows)), "feat": list(rows.astype(np.float64)), "ratio": ratio, "width": pixels.shape[1], "height": pixels.shape[0]})

    return images.select("image_id", "content").mapInPandas(run, "image_id bigint, anchor_ix int, feat array<double>, ratio double, width int, height int")
