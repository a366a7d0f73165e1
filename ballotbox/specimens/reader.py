"""A reader of clean, upright codes: white gaps part an image into pieces, a piece is a QR matrix or the runs of a linear code.

It stands in for the native decoders where those are missing, reads what the generators draw and photographs of nothing.
"""

from __future__ import annotations

import numpy as np

from ..sources.pixels import decode
from . import linear, qr

#: White rows or columns that part two pieces. Wider than the gaps inside a code, narrower than two quiet borders.
GAP = 14


def pieces(dark: np.ndarray, y0: int = 0, x0: int = 0) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of dark areas parted by white rows and columns, top to bottom, then left to right."""
    rows, columns = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    if not len(rows):
        return []
    for at, axis in ((rows, 0), (columns, 1)):
        cuts = np.flatnonzero(np.diff(at) > GAP)
        if len(cuts):
            starts, ends = [at[0], *at[cuts + 1]], [*(at[cuts] + 1), at[-1] + 1]
            out = []
            for a, b in zip(starts, ends, strict=True):
                out += pieces(dark[a:b] if axis == 0 else dark[:, a:b], y0 + (a if axis == 0 else 0), x0 + (a if axis == 1 else 0))
            return out
    return [(x0 + int(columns[0]), y0 + int(rows[0]), x0 + int(columns[-1]) + 1, y0 + int(rows[-1]) + 1)]


def _matrix(dark: np.ndarray) -> str | None:
    h, w = dark.shape
    if abs(h - w) > 2 or min(h, w) < 21:
        return None
    for n in range(21, 58, 4):
        at = ((np.arange(n) + 0.5) * h / n).astype(int)
        m = dark[np.ix_(at, ((np.arange(n) + 0.5) * w / n).astype(int))]
        if (text := qr.read(m)) is not None:
            return text
    return None


def _linear(dark: np.ndarray) -> tuple[str, str] | None:
    for share in (0.5, 0.25, 0.75):
        row = dark[int(len(dark) * share)]
        edges = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0))
        runs = np.diff(edges).tolist()
        if found := linear.read_runs(runs):
            return found
    return None


def read(pixels: np.ndarray) -> list[dict]:
    """Raw reads: text, symbology, valid, and the corners from the top left on, clockwise."""
    dark, out = pixels.reshape(*pixels.shape[:2], -1).mean(2) < 128, []
    for x1, y1, x2, y2 in pieces(dark):
        piece = dark[y1:y2, x1:x2]
        text = _matrix(piece)
        found = ("qr", text) if text is not None else _linear(piece)
        if found:
            out.append({"symbology": found[0], "text": found[1], "valid": True, "corners": [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]})
    return out


class Plain:
    """The reader as an engine."""

    name, native_format, thread_safety = "plain", "rgb", "shared"

    def detect_and_decode(self, content: bytes) -> list[dict]:
        out = []
        for r in read(decode(content)):
            (x1, y1), _, (x2, y2), _ = r["corners"]
            out.append({"x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2), "symbology": r["symbology"], "payload": r["text"], "score": 1.0, "polygon": [{"x": float(x), "y": float(y)} for x, y in r["corners"]], "extras": {"decoder": "plain"}})
        return out
