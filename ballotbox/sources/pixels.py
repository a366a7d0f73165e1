"""Pixels from files without a native codec: PNG, BMP, GIF (first frame), and the PPM family, in numpy; and PNG and PPM back.

Everything that can't be read raises InvalidImage, whatever went wrong inside. JPEG, TIFF, WEBP, ICO, HEIF and AVIF need a reader registered
with :func:`register_reader`, which each Python worker then builds on first use.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..errors import InvalidImage

#: Fixed value: images of more pixels are refused as decompression bombs.
MOST_PIXELS = 178_956_970
#: Leading bytes of the formats on the allow list; RIFF and ISO media files carry theirs further on.
MAGIC = {
    "jpeg": [b"\xff\xd8\xff"],
    "png": [b"\x89PNG\r\n\x1a\n"],
    "gif": [b"GIF87a", b"GIF89a"],
    "bmp": [b"BM"],
    "tiff": [b"II*\x00", b"MM\x00*"],
    "ico": [b"\x00\x00\x01\x00"],
    "ppm": [b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"],
}
#: Brands of ISO media files.
BRANDS = {"heif": [b"heic", b"heix", b"mif1"], "avif": [b"avif", b"avis"]}

_READERS: dict[str, Callable[[], Callable[[bytes], np.ndarray]]] = {}


def register_reader(kind: str, factory: Callable[[], Callable[[bytes], np.ndarray]]) -> None:
    """``factory()`` gives a function from a file's bytes to pixels; it is called once a worker, when the first such file comes."""
    _READERS[kind] = factory
    _reader.cache_clear()


@lru_cache(16)
def _reader(kind: str) -> Callable[[bytes], np.ndarray]:
    return _READERS[kind]()


def kind_of(content: bytes) -> str | None:
    for kind, heads in MAGIC.items():
        if content.startswith(tuple(heads)):
            return kind
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "webp"
    if content[4:8] == b"ftyp":
        return next((k for k, brands in BRANDS.items() if content[8:12] in brands), None)
    return None


def readable() -> tuple[str, ...]:
    """Formats that become pixels in this process."""
    return (*_OWN, *(k for k in _READERS if k not in _OWN))


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Grey, grey with one channel or with alpha, RGB or RGBA to RGB."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    return np.repeat(pixels[:, :, :1], 3, 2) if pixels.shape[2] < 3 else np.ascontiguousarray(pixels[:, :, :3])


def size_checked(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise InvalidImage(f"an image without pixels ({width} x {height})")
    if width * height > MOST_PIXELS:
        raise InvalidImage(f"a decompression bomb: {width} x {height} pixels are more than {MOST_PIXELS}")


def png_size(content: bytes) -> tuple[int, int]:
    return struct.unpack(">II", content[16:24])


def _jpeg_size(content: bytes) -> tuple[int, int]:
    at = 2
    while content[at] == 0xFF:
        mark, length = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", content[at + 5 : at + 9])
            return w, h
        at += 2 + length
    raise InvalidImage("a JPEG file without a frame")


def _webp_size(content: bytes) -> tuple[int, int]:
    kind = content[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(content[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    w, h = struct.unpack("<HH", content[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _tiff_size(content: bytes) -> tuple[int, int]:
    end = "<" if content[:2] == b"II" else ">"
    at = struct.unpack(end + "I", content[4:8])[0]
    found = {}
    for k in range(struct.unpack(end + "H", content[at : at + 2])[0]):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, form = struct.unpack(end + "HH", entry[:4])
        if tag in (256, 257):
            found[tag] = struct.unpack(end + ("H" if form == 3 else "I"), entry[8 : 10 if form == 3 else 12])[0]
    return found[256], found[257]


def _ppm_fields(content: bytes) -> tuple[list[bytes], int]:
    """Magic number, sizes and (but for bitmaps) the largest value; and where the pixels begin."""
    fields, at, wanted = [], 0, 3 if content[:2] in (b"P1", b"P4") else 4
    while len(fields) < wanted:
        while at < len(content) and content[at : at + 1].isspace():
            at += 1
        if at >= len(content):
            raise InvalidImage("a header that is cut short")
        if content[at : at + 1] == b"#":
            end = content.find(b"\n", at)
            at = len(content) if end < 0 else end
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if end >= len(content):
            raise InvalidImage("a header that is cut short")
        fields.append(content[at:end])
        at = end
    return fields, at + 1


def header_size(content: bytes, kind: str) -> tuple[int, int] | None:
    """Width and height as the header states them; None where this package doesn't read that header."""
    if kind == "ppm":
        return tuple(int(x) for x in _ppm_fields(content)[0][1:3])
    plain = {
        "png": png_size,
        "gif": lambda c: struct.unpack("<HH", c[6:10]),
        "bmp": lambda c: (struct.unpack("<i", c[18:22])[0], abs(struct.unpack("<i", c[22:26])[0])),
        "ico": lambda c: (c[6] or 256, c[7] or 256),
        "jpeg": _jpeg_size,
        "webp": _webp_size,
        "tiff": _tiff_size,
    }
    return tuple(plain[kind](content)) if kind in plain else None


def ppm(content: bytes) -> np.ndarray:
    """Any of the six PPM kinds to RGB rows."""
    fields, at = _ppm_fields(content)
    kind, w, h, most = fields[0], int(fields[1]), int(fields[2]), int(fields[3]) if len(fields) > 3 else 1
    size_checked(w, h)
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        rows = np.frombuffer(content, np.uint8, h * -(-w // 8), at).reshape(h, -1)
        return rgb((1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255))
    if kind in (b"P1", b"P2", b"P3"):
        values = np.array((b" ".join(bytes([x]) for x in content[at:] if x in b"01") if kind == b"P1" else content[at:]).split()[: w * h * channels], np.int64)
        values = 1 - values if kind == b"P1" else values
    else:
        values = np.frombuffer(content, np.uint8 if most < 256 else ">u2", w * h * channels, at).astype(np.int64)
    if len(values) < w * h * channels:
        raise InvalidImage("an image that is cut short")
    return rgb((values * 255 // max(1, most)).astype(np.uint8).reshape(h, w, channels))


_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfiltered(data: bytes, at: int, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG pass without their filters."""
    out = np.zeros((h + 1, stride + step), np.uint8)
    for y in range(h):
        kind, row = data[at], np.frombuffer(data, np.uint8, stride, at + 1)
        at += stride + 1
        own, up = out[y + 1], out[y]
        if kind == 0:
            own[step:] = row
        elif kind == 1:
            for c in range(step):
                own[step + c :: step] = np.cumsum(row[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            own[step:] = row + up[step:]
        elif kind in (3, 4):
            line, above, filtered = own.tolist(), up.tolist(), row.tolist()
            for i in range(stride):
                a, b = line[i], above[i + step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[i]
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                line[i + step] = (filtered[i] + guess) & 255
            own[:] = line
        else:
            raise InvalidImage(f"PNG filter {kind}")
    return out[1:, step:]


def png(content: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at < len(content):
        length, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + length]
        if len(body) < length:
            raise InvalidImage("a PNG file that is cut short")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            size_checked(head[0], head[1])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + length
    if head is None or not data:
        raise InvalidImage("a PNG file without pixels")
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, step, at = zlib.decompress(b"".join(data)), max(1, channels * depth // 8), 0
    out = np.zeros((h, w, channels), np.uint8)
    for y0, x0, dy, dx in _PASSES if interlaced else ((0, 0, 1, 1),):
        ph, pw = max(0, -(-(h - y0) // dy)), max(0, -(-(w - x0) // dx))
        if not ph or not pw:
            continue
        stride = -(-pw * channels * depth // 8)
        rows = _unfiltered(raw, at, ph, stride, step)
        at += ph * (stride + 1)
        if depth == 16:
            values = rows[:, ::2]
        elif depth == 8:
            values = rows
        else:
            bits = np.unpackbits(rows, axis=1).reshape(ph, -1, depth)
            values = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
            if colour == 0:
                values = values * np.uint8(255 // ((1 << depth) - 1))
        out[y0::dy, x0::dx] = values[:, : pw * channels].reshape(ph, pw, channels)
    return rgb(palette[out[:, :, 0]] if colour == 3 else out)


def bmp(content: bytes) -> np.ndarray:
    start, header = struct.unpack("<I", content[10:14])[0], struct.unpack("<I", content[14:18])[0]
    w, h, _, depth, packed = struct.unpack("<iiHHI", content[18:34])
    size_checked(w, abs(h))
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise InvalidImage(f"a BMP file of {depth} bits, packed as {packed}")
    stride = -(-w * depth // 32) * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    if depth >= 24:
        out = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(content, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)[:, 2::-1]
        bits = np.unpackbits(rows, axis=1).reshape(abs(h), -1, depth)
        out = palette[(bits @ (1 << np.arange(depth)[::-1]))[:, :w]]
    return rgb(out if h < 0 else out[::-1])


def _lzw(data: bytes, least: int, n: int) -> bytes:
    clear, out = 1 << least, bytearray()
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    bits, have, at, size, before = 0, 0, 0, least + 1, None
    while len(out) < n:
        while have < size:
            if at >= len(data):
                raise InvalidImage("a GIF file that is cut short")
            bits |= data[at] << have
            at, have = at + 1, have + 8
        code, bits, have = bits & ((1 << size) - 1), bits >> size, have - size
        if code == clear:
            table, size, before = table[: clear + 2], least + 1, None
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            before = entry
    return bytes(out[:n])


def gif(content: bytes) -> np.ndarray:
    """The first frame over the background."""
    w, h, flags, ground = struct.unpack("<HHBB", content[6:12])
    size_checked(w, h)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(content, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    while content[at] != 0x2C:
        if content[at] != 0x21:
            raise InvalidImage("a GIF file without a frame")
        at += 2
        while content[at]:
            at += 1 + content[at]
        at += 1
    x, y, fw, fh, own = struct.unpack("<HHHHB", content[at + 1 : at + 10])
    at += 10
    if own & 0x80:
        n = 2 << (own & 7)
        palette = np.frombuffer(content, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    least, at, parts = content[at], at + 1, []
    while content[at]:
        parts.append(content[at + 1 : at + 1 + content[at]])
        at += 1 + content[at]
    frame = np.frombuffer(_lzw(b"".join(parts), least, fw * fh), np.uint8).reshape(fh, fw)
    if own & 0x40:
        order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
        frame = frame[np.argsort(order)]
    out = np.full((h, w), ground if flags & 0x80 else 0, np.uint8)
    out[y : y + fh, x : x + fw] = frame[: h - y, : w - x]
    return rgb(palette[out])


_OWN = {"png": png, "bmp": bmp, "gif": gif, "ppm": ppm}


def decode(content: bytes | None) -> np.ndarray:
    """RGB rows (height, width, 3) of a file's bytes."""
    if not content:
        raise InvalidImage("no content")
    content = bytes(content)
    kind = kind_of(content)
    if kind is None:
        raise InvalidImage("not an image of a known format")
    if kind not in _OWN and kind not in _READERS:
        raise InvalidImage(f"no reader for {kind} is registered")
    try:
        if size := header_size(content, kind):
            size_checked(*size)
        pixels = rgb((_READERS and kind in _READERS and _reader(kind) or _OWN[kind])(content))
    except InvalidImage:
        raise
    except Exception as e:  # noqa: BLE001  a broken file may break anything inside
        raise InvalidImage(f"a {kind} file that can't be read: {type(e).__name__}: {e}") from e
    size_checked(pixels.shape[1], pixels.shape[0])
    return pixels


def to_ppm(pixels: np.ndarray) -> bytes:
    pixels = rgb(pixels)
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def to_png(pixels: np.ndarray) -> bytes:
    """8 bits, grey or RGB, no filter."""
    grey = pixels.ndim == 2
    h, w = pixels.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels if grey else rgb(pixels)).reshape(h, -1)], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def content_of(image) -> bytes:
    """The bytes of a file that stand for any kind of input: a path, bytes, a binary stream (``read`` and ``seek``), an array, or an object with
    ``convert`` and ``size`` whose RGB pixels an array can be made of. Files are taken as they are, pixels become a PPM file."""
    if isinstance(image, bytes | bytearray | memoryview):
        return bytes(image)
    if isinstance(image, str | os.PathLike):
        try:
            with open(image, "rb") as f:
                return f.read()
        except (OSError, ValueError) as e:
            raise InvalidImage(f"can't read {os.fspath(image)!r}: {type(e).__name__}: {e}") from e
    if hasattr(image, "read") and hasattr(image, "seek"):
        try:
            image.seek(0)
            content = image.read()
        except (OSError, ValueError) as e:
            raise InvalidImage(f"can't read {type(image).__name__}: {type(e).__name__}: {e}") from e
        if not isinstance(content, bytes):
            raise InvalidImage(f"{type(image).__name__} gives {type(content).__name__}, not bytes")
        return content
    try:
        pixels = np.asarray(image.convert("RGB") if hasattr(image, "convert") and hasattr(image, "size") else image)
    except Exception as e:  # noqa: BLE001  a stranger's object
        raise InvalidImage(f"can't take pixels of {type(image).__name__}: {type(e).__name__}: {e}") from e
    if pixels.dtype == bool:
        pixels = pixels * np.uint8(255)
    if pixels.dtype != np.uint8 or pixels.ndim not in (2, 3) or pixels.ndim == 3 and pixels.shape[2] not in (1, 2, 3, 4):
        raise InvalidImage(f"expected a path, bytes, a binary stream or 8-bit pixels of 1 to 4 channels; got {type(image).__name__} ({pixels.dtype}, {pixels.shape})")
    size_checked(pixels.shape[1], pixels.shape[0])
    return to_ppm(pixels)
