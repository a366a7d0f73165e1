"""QR codes of versions 1 to 10, error correction M, byte mode: matrices drawn, and matrices read back.

Both ways share the published layout (function patterns, mask conditions, block table) and nothing else: reading checks the Reed-Solomon
syndromes of every block and the format bits, so a wrong drawing does not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: For each version, error correction bytes a block, and how many blocks hold how many data bytes (level M).
BLOCKS = {
    1: (10, ((1, 16),)),
    2: (16, ((1, 28),)),
    3: (26, ((1, 44),)),
    4: (18, ((2, 32),)),
    5: (24, ((2, 43),)),
    6: (16, ((4, 27),)),
    7: (18, ((4, 31),)),
    8: (22, ((2, 38), (2, 39))),
    9: (22, ((3, 36), (2, 37))),
    10: (26, ((4, 43), (1, 44))),
}
#: Centres of the alignment patterns.
CENTRES = {1: (), 2: (6, 18), 3: (6, 22), 4: (6, 26), 5: (6, 30), 6: (6, 34), 7: (6, 22, 38), 8: (6, 24, 42), 9: (6, 26, 46), 10: (6, 28, 50)}
#: Generator polynomials and mask of the format and version bits; the field's polynomial.
FORMAT_POLY, FORMAT_MASK, VERSION_POLY, FIELD_POLY = 0b10100110111, 0b101010000010010, 0b1111100100101, 0x11D
#: The bits of level M, and of byte mode.
LEVEL_M, BYTE_MODE = 0b00, 0b0100


@lru_cache(1)
def _field() -> tuple[list[int], list[int]]:
    powers, logs, x = [0] * 510, [0] * 256, 1
    for i in range(255):
        powers[i] = powers[i + 255] = x
        logs[x] = i
        x = x << 1 ^ (FIELD_POLY if x & 0x80 else 0)
    return powers, logs


def _times(a: int, b: int) -> int:
    powers, logs = _field()
    return powers[logs[a] + logs[b]] if a and b else 0


@lru_cache(32)
def _generator(n: int) -> tuple[int, ...]:
    """Coefficients after the leading one of the product of (x - 2**i) for i below n."""
    out, powers = [1], _field()[0]
    for i in range(n):
        out = [a ^ _times(b, powers[i]) for a, b in zip([*out, 0], [0, *out], strict=True)]
    return tuple(out[1:])


def remainder(data: bytes, n: int) -> bytes:
    """The ``n`` error correction bytes of a block."""
    rest, poly = [0] * n, _generator(n)
    for x in data:
        lead = x ^ rest[0]
        rest = [a ^ _times(lead, p) for a, p in zip([*rest[1:], 0], poly, strict=True)]
    return bytes(rest)


def syndromes(block: bytes, n: int) -> list[int]:
    """All zero for an intact block."""
    powers, out = _field()[0], []
    for i in range(n):
        s = 0
        for x in block:
            s = _times(s, powers[i]) ^ x
        out.append(s)
    return out


def capacity(version: int) -> int:
    """Bytes of text that fit."""
    data = sum(n * k for n, k in BLOCKS[version][1])
    return data - (2 if version < 10 else 3)


def _bch(value: int, poly: int, width: int) -> int:
    rest = value << width
    while rest.bit_length() > width:
        rest ^= poly << rest.bit_length() - poly.bit_length()
    return value << width | rest


def _layout(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Function patterns with format and version bits left light, and where they stand."""
    n = 17 + 4 * version
    dark, fixed = np.zeros((n, n), bool), np.zeros((n, n), bool)
    ring = np.maximum.outer(np.abs(np.arange(7) - 3), np.abs(np.arange(7) - 3))
    finder = (ring != 2) & (ring <= 3)
    for y, x in ((0, 0), (0, n - 7), (n - 7, 0)):
        dark[y : y + 7, x : x + 7] = finder
        fixed[max(0, y - 1) : y + 8, max(0, x - 1) : x + 8] = True
    for y in CENTRES[version]:
        for x in CENTRES[version]:
            if not fixed[y, x]:
                dark[y - 2 : y + 3, x - 2 : x + 3] = ring[1:6, 1:6] != 1
                fixed[y - 2 : y + 3, x - 2 : x + 3] = True
    for k in range(8, n - 8):
        dark[6, k] = dark[k, 6] = k % 2 == 0
    fixed[6, :] = fixed[:, 6] = True
    fixed[8, :9] = fixed[:9, 8] = fixed[8, n - 8 :] = fixed[n - 8 :, 8] = True
    dark[n - 8, 8] = True
    if version >= 7:
        fixed[:6, n - 11 : n - 8] = fixed[n - 11 : n - 8, :6] = True
    return dark, fixed


def _path(fixed: np.ndarray) -> list[tuple[int, int]]:
    """Data modules in reading order: pairs of columns from the right, up and down in turn, past the timing column."""
    n, out, up = len(fixed), [], True
    for right in [x for x in range(n - 1, 0, -2) if x > 6] + [5, 3, 1]:
        for k in range(n):
            y = n - 1 - k if up else k
            out += [(y, x) for x in (right, right - 1) if not fixed[y, x]]
        up = not up
    return out


def masks(n: int) -> list[np.ndarray]:
    """The eight mask conditions."""
    y, x = np.indices((n, n))
    return [(y + x) % 2 == 0, y % 2 == 0, x % 3 == 0, (y + x) % 3 == 0, (y // 2 + x // 3) % 2 == 0, y * x % 2 + y * x % 3 == 0, (y * x % 2 + y * x % 3) % 2 == 0, ((y + x) % 2 + y * x % 3) % 2 == 0]


def _format_places(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Both copies' modules, from the highest bit on."""
    near = [(8, x) for x in (0, 1, 2, 3, 4, 5, 7, 8)] + [(y, 8) for y in (7, 5, 4, 3, 2, 1, 0)]
    far = [(n - 1 - k, 8) for k in range(7)] + [(8, n - 8 + k) for k in range(8)]
    return near, far


def penalty(m: np.ndarray) -> int:
    """The four rules by which the mask is chosen."""
    total, n = 0, len(m)
    for grid in (m, m.T):
        for row in grid:
            edges = np.flatnonzero(np.diff(row.astype(np.int8), prepend=2, append=2))
            runs = np.diff(edges)
            total += int((runs[runs >= 5] - 2).sum())
        text = ["".join("1" if v else "0" for v in row) for row in grid]
        total += 40 * sum(row[k : k + 11] in ("10111010000", "00001011101") for row in text for k in range(n - 10))
    same = (m[:-1, :-1] == m[1:, :-1]) & (m[:-1, :-1] == m[:-1, 1:]) & (m[:-1, :-1] == m[1:, 1:])
    return total + 3 * int(same.sum()) + 10 * int(abs(m.mean() * 100 - 50) // 5)


def matrix(text: str, least_version: int = 1) -> np.ndarray:
    """Modules (True is dark) of the smallest version from ``least_version`` on that holds the text."""
    raw = text.encode()
    version = next((v for v in range(least_version, 11) if capacity(v) >= len(raw)), None)
    if version is None:
        raise ValueError(f"{len(raw)} bytes are more than version 10 holds")
    check, groups = BLOCKS[version]
    total = sum(n * k for n, k in groups)
    width = 8 if version < 10 else 16
    bits = f"{BYTE_MODE:04b}{len(raw):0{width}b}" + "".join(f"{b:08b}" for b in raw)
    bits += "0" * min(4, 8 * total - len(bits))
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    data += (b"\xec\x11" * total)[: total - len(data)]
    blocks, at = [], 0
    for n, k in groups:
        for _ in range(n):
            blocks.append(data[at : at + k])
            at += k
    longest = max(map(len, blocks))
    stream = bytes(b[i] for i in range(longest) for b in blocks if i < len(b))
    checks = [remainder(b, check) for b in blocks]
    stream += bytes(c[i] for i in range(check) for c in checks)
    plain, fixed = _layout(version)
    n = len(plain)
    flat = np.unpackbits(np.frombuffer(stream, np.uint8))
    path = _path(fixed)
    for (y, x), bit in zip(path, flat, strict=False):  # a few modules may be left over, they stay light
        plain[y, x] = bit
    if version >= 7:
        code = _bch(version, VERSION_POLY, 12)
        for i in range(18):
            plain[i // 3, n - 11 + i % 3] = plain[n - 11 + i % 3, i // 3] = code >> i & 1
    best = None
    for k, mask in enumerate(masks(n)):
        m = plain ^ (mask & ~fixed)
        code = _bch(LEVEL_M << 3 | k, FORMAT_POLY, 10) ^ FORMAT_MASK
        for places in _format_places(n):
            for i, (y, x) in enumerate(places):
                m[y, x] = code >> 14 - i & 1
        cost = penalty(m)
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1]


def read(m: np.ndarray) -> str | None:
    """The text of an intact matrix of this kind; None if anything in it doesn't fit."""
    n = len(m)
    version, rest = divmod(n - 17, 4)
    if rest or version not in BLOCKS or m.shape != (n, n):
        return None
    plain, fixed = _layout(version)
    code = sum(int(m[y, x]) << 14 - i for i, (y, x) in enumerate(_format_places(n)[0])) ^ FORMAT_MASK
    if _bch(code >> 10, FORMAT_POLY, 10) != code or code >> 13 != LEVEL_M:
        return None
    path = _path(fixed)
    clear = m ^ masks(n)[code >> 10 & 7]
    bits = np.array([clear[p] for p in path], np.uint8)
    stream = np.packbits(bits[: len(bits) // 8 * 8]).tobytes()
    check, groups = BLOCKS[version]
    sizes = [k for c, k in groups for _ in range(c)]
    blocks = [bytearray() for _ in sizes]
    at = 0
    for i in range(max(sizes)):
        for b, k in zip(blocks, sizes, strict=True):
            if i < k:
                b.append(stream[at])
                at += 1
    ends = [bytes(stream[at + i + len(sizes) * j] for j in range(check)) for i in range(len(sizes))]
    if any(any(syndromes(bytes(b) + e, check)) for b, e in zip(blocks, ends, strict=True)):
        return None
    text = "".join(f"{x:08b}" for b in blocks for x in b)
    width = 8 if version < 10 else 16
    if int(text[:4], 2) != BYTE_MODE:
        return None
    size = int(text[4 : 4 + width], 2)
    start = 4 + width
    raw = bytes(int(text[start + 8 * i : start + 8 * i + 8], 2) for i in range(size))
    return raw.decode("utf-8", "replace")


def image(text: str, box: int = 10, border: int = 4, least_version: int = 1) -> np.ndarray:
    """Grey pixels, dark on white, with a quiet border of ``border`` modules."""
    m = np.pad(matrix(text, least_version), border)
    return np.where(np.kron(m, np.ones((box, box), bool)), 0, 255).astype(np.uint8)
