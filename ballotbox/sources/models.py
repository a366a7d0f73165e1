"""Model files: metadata, execution providers, a session for each worker, and a dry run before a job starts."""

from __future__ import annotations

import logging
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineMissing
from ..functions.geometry import LETTERBOX
from ..operators.postprocess import engine_name, family, num_classes, stated
from .images import anchor_rows

log = logging.getLogger(__name__)

#: Metadata keys that a whole export carries (after the tool's own prefix), and providers in order of preference.
KEYS = ("arch", "num_classes", "model_version", "model_source", "input_size", "qr_map_50", "overall_map_50")
PREFERRED = ("CoreMLExecutionProvider", "CUDAExecutionProvider")
CPU = "CPUExecutionProvider"


@lru_cache(1)
def available_providers() -> tuple[str, ...]:
    try:
        import onnxruntime
    except ImportError:
        return ()
    return tuple(onnxruntime.get_available_providers())


def features(spark: SparkSession) -> dict[str, object]:
    """What can be read and run here: formats that Python and the JVM decode, the runtime and its providers."""
    from importlib.metadata import PackageNotFoundError, version

    from .pixels import readable

    try:
        runtime = version("onnxruntime")
    except PackageNotFoundError:
        runtime = None
    jvm = sorted({str(x).lower() for x in spark._jvm.javax.imageio.ImageIO.getReaderFormatNames()})
    return {"python_formats": readable(), "jvm_formats": tuple(jvm), "onnxruntime": runtime, "providers": available_providers(), "cuda": "CUDAExecutionProvider" in available_providers(), "coreml": "CoreMLExecutionProvider" in available_providers()}


def providers(wanted: list[str] | tuple[str, ...] | None = None) -> list[str]:
    """The caller's list with the CPU behind it, else what is preferred and there, then the CPU."""
    chosen = list(wanted) if wanted is not None else [x for x in PREFERRED if x in available_providers()]
    return chosen if CPU in chosen else [*chosen, CPU]


@lru_cache(4)
def session(model: str, chosen: tuple[str, ...]):
    """Built once a process; Python workers keep theirs from task to task."""
    try:
        import onnxruntime
    except ImportError as e:
        raise EngineMissing("onnxruntime is not installed") from e
    try:
        return onnxruntime.InferenceSession(model, providers=list(chosen))
    except Exception as e:  # noqa: BLE001  the runtime's own kinds
        raise EngineMissing(f"model {model}: {type(e).__name__}: {e}") from e


def metadata(model: str, wanted: list[str] | None = None, whole: bool = False) -> dict[str, str]:
    """The model's own keys; ``whole``: tell which of the usual ones are missing."""
    found = dict(session(model, tuple(providers(wanted))).get_modelmeta().custom_metadata_map)
    missing = [k for k in KEYS if stated(found, k) is None]
    if whole and missing:
        log.warning("model %s lacks the metadata keys %s", model, ", ".join(missing))
    return found


def described(spark: SparkSession, models: dict[str, str], arch: str | None = None) -> DataFrame:
    """(model, arch, layout, engine, num_classes) of model files by name: a row each, read on the driver."""
    rows = []
    for name, path in models.items():
        own = session(path, tuple(providers()))
        told = dict(own.get_modelmeta().custom_metadata_map)
        kind = arch or stated(told, "arch")
        shape = own.get_outputs()[0].shape
        wide = shape[1] if family(kind) == "yolo11" else shape[-1]
        classes = num_classes(told, (wide + (4 if family(kind) == "rtdetr" else 0)) if isinstance(wide, int) else None, family(kind))
        rows.append((name, kind, family(kind), engine_name(kind), classes))
    return spark.createDataFrame(rows, "model string, arch string, layout string, engine string, num_classes int")


def preflight(model: str, arch: str | None = None, wanted: list[str] | None = None) -> int:
    """Run zeros through the model and check that its output fits the layout; the number of anchors. Whatever breaks means that the engine isn't there."""
    own = session(model, tuple(providers(wanted)))
    kind = arch or stated(dict(own.get_modelmeta().custom_metadata_map), "arch")
    try:
        rows = anchor_rows(own.run(None, {own.get_inputs()[0].name: np.zeros((1, 3, LETTERBOX, LETTERBOX), np.float32)}), kind)
    except Exception as e:  # noqa: BLE001  a model may fail in any way
        raise EngineMissing(f"model {model} fails on an empty image as {family(kind)} (input {own.get_inputs()[0].name}, providers {own.get_providers()}): {type(e).__name__}: {e}") from e
    return len(rows)
