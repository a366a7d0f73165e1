"""The scanner: which engines run, how they vote, and what a scan returns."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineFailed, EngineMissing, InvalidImage
from ..functions.geometry import BOX, downscaled, rescaled_polygon
from ..operators.consensus import IOU, fan_out, merge
from ..schema import DETECTIONS, ENGINES, OWN, POLYGON
from ..sources.images import preprocessed, table_of
from ..sources.pixels import to_ppm


@runtime_checkable
class Engine(Protocol):
    """Anything that turns an image's bytes into detections: a list of dicts with x1, y1, x2, y2, symbology, score, payload."""

    name: str

    def detect_and_decode(self, content: bytes) -> list[dict]: ...


#: name -> factory; an engine is there if its factory is. The library's own engines need packages this image may lack.
REGISTRY: dict[str, Callable[[], Engine]] = {}


def register(name: str, factory: Callable[[], Engine]) -> None:
    REGISTRY[name] = factory


def installed() -> tuple[str, ...]:
    """Registered engines, known ones in canonical order first."""
    return (*(e for e in ENGINES if e in REGISTRY), *(e for e in REGISTRY if e not in ENGINES))


def build(name: str) -> Engine:
    if name not in REGISTRY:
        raise EngineMissing(f"engine {name!r} is not installed; installed are {', '.join(installed()) or 'none'}")
    return REGISTRY[name]()


def check_subset(engines) -> tuple[str, ...]:
    if not isinstance(engines, (tuple, list)):
        raise TypeError("engines must be a tuple or a list")
    if not engines:
        raise ValueError("engines must not be empty")
    if not all(isinstance(e, str) for e in engines):
        raise TypeError("engines must be names")
    if len(set(engines)) < len(engines):
        raise ValueError("engines must be unique")
    if unknown := [e for e in engines if e not in ENGINES and e not in REGISTRY]:
        raise ValueError(f"unknown engines: {', '.join(unknown)}")
    if missing := [e for e in engines if e not in REGISTRY]:
        raise EngineMissing(f"engines that are not installed: {', '.join(missing)}")
    return tuple(engines)


def in_original(found: dict, sx: float, sy: float) -> dict:
    """A detection made on a downscaled image, in the original's pixels."""
    moved = {c: found[c] * (sx if c[0] == "x" else sy) for c in BOX}
    if found.get("polygon") is not None:
        points = [(p["x"], p["y"]) if isinstance(p, dict) else p for p in found["polygon"]]
        moved["polygon"] = [{"x": x * sx, "y": y * sy} for x, y in points]
    return found | moved


def attempt(engine: Engine, content: bytes, preprocess: str) -> list[dict]:
    """One engine's detections on one image, in the pixels of the image as it was given."""
    if preprocess == "off":
        return engine.detect_and_decode(content)
    content, sx, sy = preprocessed(content)
    found = engine.detect_and_decode(content)
    return found if sx == sy == 1 else [in_original(d, sx, sy) for d in found]


#: What ``scanned`` gives: detections (kind "found"), and for each image and engine one row (kind "run") with its time and its error.
SCANNED = f"kind string, {DETECTIONS}, ms double, preprocess_ms double, error_type string, error_message string"
_FIELDS, _ALL = ([x.split()[0] for x in s.split(", ")] for s in (DETECTIONS, SCANNED))


def scanned(images: DataFrame, engines: dict[str, Callable[[], Engine]], preprocess: str = "off") -> DataFrame:
    """All engines over ``images(image_id, content)`` in one pass: each image is read and preprocessed once for all of them, each engine is built once a task.

    An engine that raises contributes nothing but its error, so one engine never fails the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = {name: make() for name, make in engines.items()}
        try:
            for pdf in batches:
                out = []
                for image_id, content in zip(pdf["image_id"], pdf["content"], strict=True):
                    out += _scan_one(image_id, content, built, preprocess)
                yield pd.DataFrame(out, columns=_ALL).astype({"det_ix": "Int64", "engine_rank": "Int64"})
        finally:
            for engine in built.values():
                getattr(engine, "close", lambda: None)()

    return images.select("image_id", "content").mapInPandas(run, SCANNED)


def _scan_one(image_id: int, content: bytes, engines: dict[str, Engine], preprocess: str) -> list[dict]:
    out, sx, sy, early, preprocess_ms = [], 1.0, 1.0, None, None
    if preprocess != "off":
        began = time.perf_counter()
        try:
            content, sx, sy = preprocessed(content)
        except InvalidImage as e:
            early = e
        preprocess_ms = (time.perf_counter() - began) * 1000
    for rank, (name, engine) in enumerate(engines.items()):
        began, error, found = time.perf_counter(), early, []
        if early is None:
            try:
                found = list(engine.detect_and_decode(content))
            except Exception as e:  # noqa: BLE001  an engine may raise anything; its contribution is then empty
                error = e
        ms = (time.perf_counter() - began) * 1000
        found = found if sx == sy == 1 else [in_original(d, sx, sy) for d in found]
        blank = dict.fromkeys(_ALL) | {"image_id": image_id, "engine": name, "engine_rank": rank}
        out += [blank | {"kind": "found", "det_ix": i, "extras": {}, "score": 1.0} | {k: v for k, v in d.items() if k in _FIELDS} | {"engine": name} for i, d in enumerate(found)]
        out.append(blank | {"kind": "run", "ms": ms, "preprocess_ms": preprocess_ms, "error_type": error and type(error).__name__, "error_message": error and str(error)})
    return out


def detect(images: DataFrame, name: str, factory: Callable[[], Engine] | None = None, preprocess: str = "off") -> DataFrame:
    """Detections of one engine over ``images(image_id, content)``. An image on which the engine raises gives no rows; ``detect_errors`` tells why.
    With ``preprocess`` 'auto' the engine gets each image downscaled and autocontrasted; images that can't be read then give no rows."""
    return scanned(images, {name: factory or REGISTRY[name]}, preprocess).filter("kind = 'found'").select(*_FIELDS)


def detect_errors(images: DataFrame, name: str, factory: Callable[[], Engine] | None = None, preprocess: str = "off") -> DataFrame:
    """``(image_id, engine, type, message)`` of the images on which the engine raises in ``detect``; runs the engine anew (a ``Scanner`` doesn't)."""
    runs = scanned(images, {name: factory or REGISTRY[name]}, preprocess).filter("error_type is not null")
    return runs.select("image_id", "engine", F.col("error_type").alias("type"), F.col("error_message").alias("message"))


_MERGED = ("engine", "symbology", "payload", "score", *BOX, "polygon", "extras", "voted_by", "vote_count", "agreed_payloads", "source_count")
_RAW = ("engine", "symbology", "payload", "score", *BOX, "polygon", "extras")


class Scanner:
    """``engine``: one engine (its name, or an object with ``name`` and ``detect_and_decode``), its detections as they are. ``engines``: several by name, or name -> factory for
    a mix of own ones, merged where at least ``consensus`` of them agree (1: union). Neither: all that are installed.

    A scanner keeps the detections of its scans (not the images) persisted, so that voting, raw detections, times and errors come from one run of the
    engines; ``close``, or the end of a ``with`` block, releases them. It may be used again afterwards.
    """

    def __init__(self, engine: str | Engine | None = None, *, engines=None, consensus: int = 1, preprocess: str = "off", iou_threshold: float = IOU, model=None):
        if model is not None:
            raise NotImplementedError("model is reserved: register an engine for own weights and name it")
        if engine is not None and engines is not None:
            raise ValueError("engine and engines exclude one another")
        if isinstance(consensus, bool) or not isinstance(consensus, int):
            raise TypeError("consensus must be an int")
        if consensus < 1:
            raise ValueError("consensus must be 1 or more")
        if not 0 <= iou_threshold <= 1:
            raise ValueError("iou_threshold must be in [0, 1]")
        if preprocess not in ("off", "auto"):
            raise ValueError("preprocess must be 'off' or 'auto'")
        if engine is not None and consensus != 1:
            raise ValueError("consensus needs several engines")
        self.consensus, self.preprocess, self.iou_threshold, self._held = consensus, preprocess, iou_threshold, []
        if engine is not None and not isinstance(engine, str):
            if not isinstance(engine, Engine):
                raise TypeError(f"engine must be a name or have name and detect_and_decode; {type(engine).__name__} has not")
            self.engines, self.factories = (engine.name,), {engine.name: lambda: engine}
        elif isinstance(engines, dict) and engines:
            self.engines, self.factories = tuple(engines), dict(engines)
        else:
            if engine in ("auto", "consensus") or engine is not None and engine not in ENGINES and engine not in REGISTRY:
                raise ValueError(f"engine {engine!r} is no engine")
            self.engines = check_subset((engine,) if engine is not None else engines if engines is not None else installed())
            self.factories = {e: REGISTRY[e] for e in self.engines}
        if consensus > len(self.engines):
            raise ValueError(f"consensus of {consensus} is beyond {len(self.engines)} engines")
        self.single = len(self.engines) == 1

    @property
    def engine_name(self) -> str:
        return self.engines[0] if self.single else "consensus"

    def __repr__(self) -> str:
        return f"Scanner(engines={self.engines!r}, consensus={self.consensus}, preprocess={self.preprocess!r})"

    def __enter__(self) -> Scanner:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Release what scans have kept; more than once is fine."""
        held, self._held = self._held, []
        for x in held:
            x.unpersist()

    def warmup(self) -> None:
        """Build each engine here, let it warm up if it can, and give it a small white image. What an engine lacks shows now; that it can't read the image doesn't."""
        for make in self.factories.values():
            engine = make()
            getattr(engine, "warmup", lambda: None)()
            with contextlib.suppress(EngineFailed):
                engine.detect_and_decode(to_ppm(np.full((16, 16, 3), 255, np.uint8)))

    def results(self, raw: DataFrame, images: DataFrame, runs: DataFrame | None = None) -> DataFrame:
        """One row per image of ``images(image_id, width, height)`` from all engines' detections ``raw``: merged ones best first, raw ones by engine, the original size, and of
        ``runs`` times and errors. Images and engines without detections appear with empty arrays."""
        for c, kind in (("polygon", POLYGON), ("extras", "map<string,string>")):
            raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast(kind))
        if self.single:
            votes = {"voted_by": F.array("engine"), "vote_count": F.lit(1), "agreed_payloads": F.when(F.col("payload").isNotNull(), F.array("payload")).otherwise(F.array().cast("array<string>")), "source_count": F.lit(1)}
            merged = raw.withColumns(votes)
        else:
            merged = merge(raw, self.consensus, self.iou_threshold).withColumn("extras", F.create_map().cast("map<string,string>"))
        # maps can't be sorted: they travel as entries
        flat = lambda c: F.map_entries(c).alias(c) if c == "extras" else F.col(c)
        whole = lambda names: lambda d: F.struct(*[(F.map_from_entries(d[c]) if c == "extras" else d[c]).alias(c) for c in names])
        place = F.struct((-F.col("score")).alias("order"), F.col("det_ix" if self.single else "code_ix").alias("ix"), *map(flat, _MERGED))
        best = merged.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(place)), whole(_MERGED)).alias("detections"))
        own = raw.groupBy("image_id", "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_ix", *map(flat, _RAW)))), whole(_RAW)).alias("raw"))
        each = own.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("engine", "raw"))).alias("own"))
        out = images.join(best, "image_id", "left").join(each, "image_id", "left")
        none = F.array().cast(f"array<struct<{', '.join(f'{c}:{t}' for c, t in _kinds(_RAW))}>>")
        per_engine = F.map_from_arrays(F.array(*[F.lit(e) for e in self.engines]), F.array(*[F.coalesce(F.element_at("own", F.lit(e)), none) for e in self.engines]))
        empty = F.array().cast(f"array<struct<{', '.join(f'{c}:{t}' for c, t in _kinds(_MERGED))}>>")
        out = out.select("image_id", "width", "height", F.coalesce("detections", empty).alias("detections"), per_engine.alias("raw")).withColumn("n", F.size("detections")).withColumn("per_engine", F.transform_values("raw", lambda k, v: F.size(v)))
        if runs is None:
            return out
        entry = lambda v: F.map_from_entries(F.collect_list(F.struct("engine", v.alias("v"))))
        broken = F.map_from_entries(F.collect_list(F.when(F.col("error_type").isNotNull(), F.struct("engine", F.struct(F.col("error_type").alias("type"), F.col("error_message").alias("message")).alias("v")))))
        label = "engine" if self.single else "consensus"
        times = runs.groupBy("image_id").agg(entry(F.col("ms")).alias("engine_ms"), F.sum("ms").alias("__all"), F.max("preprocess_ms").alias("__pre"), broken.alias("errors"))
        pairs = F.array(F.struct(F.lit(label).alias("key"), F.col("__all").alias("value")), F.struct(F.lit("preprocess").alias("key"), F.col("__pre").alias("value")))
        times = times.withColumn("timings_ms", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))).drop("__all", "__pre")
        return out.join(times, "image_id", "left")

    def scan_detections(self, parts: dict[str, DataFrame], images: DataFrame) -> DataFrame:
        """Results from tables of detections, one for each engine, in place of running the engines."""
        return self.results(fan_out(parts), images)

    def scan(self, images: DataFrame) -> DataFrame:
        """Run the engines over ``images(image_id, width, height, content)``."""
        kept = scanned(images, self.factories, self.preprocess).persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(kept)
        return self.results(kept.filter("kind = 'found'").select(*_FIELDS), images.select("image_id", "width", "height"), kept.filter("kind = 'run'"))

    def scan_batch(self, spark: SparkSession, inputs: Iterable, on_error: str = "capture") -> DataFrame:
        """Inputs of any kind (paths, bytes, binary streams, arrays), one row each in their order: ``input_ix``, ``error`` of an input that is no image, and the columns of
        ``scan``. With ``on_error`` 'raise' such an input, or an engine that raises, fails the job."""
        if on_error not in ("capture", "raise"):
            raise ValueError("on_error must be 'capture' or 'raise'")
        table = table_of(spark, inputs)
        out = table.select("image_id", "path", "error").join(self.scan(table.filter("error is null")), "image_id", "left").withColumnRenamed("image_id", "input_ix")
        if on_error == "raise":
            first = F.coalesce(F.col("error.message"), F.try_element_at(F.map_values("errors"), F.lit(1))["message"])
            out = out.withColumn("input_ix", F.when(first.isNull(), F.col("input_ix")).otherwise(F.raise_error(first).cast("bigint")))
        return out.orderBy("input_ix")


def _kinds(names: tuple[str, ...]) -> list[tuple[str, str]]:
    kinds = dict(x.split(maxsplit=1) for x in DETECTIONS.split(", ")) | {"voted_by": "array<string>", "vote_count": "int", "agreed_payloads": "array<string>", "source_count": "int"}
    return [(c, kinds[c]) for c in names]


def table_engine(name: str) -> Engine:
    """An engine whose images are JSON: ``{engine: [detection, ...]}``. Recorded detections pass through a whole scan with it."""

    class Recorded:
        def __init__(self):
            self.name = name

        def detect_and_decode(self, content: bytes) -> list[dict]:
            return json.loads(content).get(name) or []

    return Recorded()


def hints(engine: Engine) -> dict[str, str]:
    """What an engine says of itself: the pixels that it likes best, and whether one instance may serve several threads. A Python worker runs one task with its own
    instances, so neither changes a scan."""
    return {"native_format": getattr(engine, "native_format", "any"), "thread_safety": getattr(engine, "thread_safety", "shared")}


def auto_resolve() -> str:
    """The first installed engine in canonical order."""
    if not installed():
        raise EngineMissing("no engine is installed")
    return installed()[0]


def rescaled(det: DataFrame, images: DataFrame) -> DataFrame:
    """Detections made on automatically downscaled images, back in the original's pixels."""
    w, h = downscaled(F.col("width"), F.col("height"))
    sizes = images.select("image_id", (F.col("width") / w).alias("__sx"), (F.col("height") / h).alias("__sy"))
    met = det.join(sizes, "image_id")
    moved = {c: F.col(c) * F.col("__sx" if c[0] == "x" else "__sy") for c in ("x1", "y1", "x2", "y2")}
    if "polygon" in det.columns:
        moved["polygon"] = rescaled_polygon(F.col("polygon"), F.col("__sx"), F.col("__sy"))
    return met.withColumns(moved).drop("__sx", "__sy")


def physical_cores() -> int:
    """Distinct (package, core) pairs of /proc/cpuinfo, else half the logical ones."""
    found, package = set(), None
    try:
        with open("/proc/cpuinfo") as f:
            for line in f:
                k, _, v = line.partition(":")
                if k.strip() == "physical id":
                    package = v.strip()
                elif k.strip() == "core id":
                    found.add((package, v.strip()))
    except OSError:
        pass
    return len(found) or max(1, (os.cpu_count() or 2) // 2)


def recommended_workers(engine: str = "consensus", neural: str | None = None) -> int:
    """How many tasks of an engine one host runs well; the partition count for a scan is this times the executors. ``neural``: the class of the host's neural
    accelerator, "ultra", "standard" or None."""
    cpus = os.cpu_count() or 1
    return {
        OWN: min(8, max(2, cpus // 2)),
        "zxing": cpus,
        "wechat": min(8, max(2, physical_cores() * 3 // 4)),
        "apple_vision": {"ultra": min(cpus, 16), "standard": min(cpus, 8)}.get(neural, 2),
        "consensus": max(1, len(installed())),
    }.get(engine, max(1, cpus // 2))
