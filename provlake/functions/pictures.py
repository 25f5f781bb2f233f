"""The structure of picture files: their size, and what is wrong with damaged ones; pixels and perceptual hash of PNG files."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

# Fixed values of the formats.
_PNG = b"\x89PNG\r\n\x1a\n"
_JPEG = b"\xff\xd8"
_OTHERS = (b"GIF87a", b"GIF89a", b"RIFF", b"II*\x00", b"MM\x00*", b"BM")
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: The first marker after the data of a JPEG scan: no stuffed zero, no restart.
_MARKER = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


class NoPicture(ValueError):
    """The bytes are damaged, or no picture at all."""


def _png(data: bytes) -> tuple[int, int]:
    at, size, pixels = len(_PNG), None, False
    while at + 12 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            break
        if zlib.crc32(data[at + 4 : at + 8 + n]) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise NoPicture("bad checksum")
        if kind == b"IHDR" and n == 13:
            size = int.from_bytes(data[at + 8 : at + 12], "big"), int.from_bytes(data[at + 12 : at + 16], "big")
        pixels |= kind == b"IDAT"
        if kind == b"IEND":
            if size is None or not pixels:
                raise NoPicture("no picture")
            return size
        at += 12 + n
    raise NoPicture("truncated")


def _jpeg(data: bytes) -> tuple[int, int]:
    at, size, scans = len(_JPEG), None, 0
    while found := _MARKER.match(data, at):
        kind, at = data[found.end() - 1], found.end()
        if kind == 0xD9:
            if size is None or not scans:
                raise NoPicture("no picture")
            return size
        if kind == 0x01:
            continue
        n = int.from_bytes(data[at : at + 2], "big")
        if n < 2 or at + n > len(data):
            break
        if kind in _FRAMES and n >= 7:
            size = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
        at += n
        if kind == 0xDA:
            scans += 1
            after = _MARKER.search(data, at)
            if after is None:
                break
            at = after.start()
    else:
        if at < len(data):
            raise NoPicture("bad marker")
    raise NoPicture("truncated")


def examined(data: bytes) -> tuple[int | None, int | None]:
    """Width and height of a PNG or JPEG whose parts are whole; NoPicture for a damaged one or no picture.

    Of other known formats only the first bytes are looked at, so their size is not told.
    """
    if data.startswith(_PNG):
        return _png(data)
    if data.startswith(_JPEG):
        return _jpeg(data)
    if data.startswith(_OTHERS):
        return None, None
    raise NoPicture("no picture")


#: Samples of a pixel by colour type; the weights of red, green and blue in luminance, in thousandths; side of the picture that is hashed, and of its lowest frequencies.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_WEIGHTS = np.array([299, 587, 114])
_SIDE, _LOW = 32, 8


def _unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """The pixels of PNG scan lines of `width` pixels, `step` bytes each, after the filter's number.

    A byte adds to what its filter guesses from the pixels left of it, above it and above the left one; so
    the pixels of a diagonal depend on earlier diagonals only, and are done all at once.
    """
    lines = raw[: rows * (width * step + 1)].reshape(rows, width * step + 1)
    kinds, given = lines[:, 0], lines[:, 1:].reshape(rows, width, step)
    if (kinds > 4).any():
        raise NoPicture("bad filter")
    out = np.zeros((rows + 1, width + 1, step), np.uint8)  # with zeros above and to the left
    for t in range(rows + width - 1):
        y = np.arange(max(0, t - width + 1), min(rows - 1, t) + 1)
        x = t - y
        a, b, c = (out[i, j].astype(np.int16) for i, j in ((y + 1, x), (y, x + 1), (y, x)))
        to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        kind = kinds[y][:, None]
        guess = np.choose(kind, [np.zeros_like(a), a, b, (a + b) // 2, nearest])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:]


def pixels(data: bytes) -> np.ndarray | None:
    """The pixels of a whole PNG (rows, columns, samples: grey, or red, green, blue); transparency is left out. Null for interlaced ones and those of fewer or more bits a sample than 8."""
    width, height = _png(data)
    at, packed, palette = len(_PNG), [], None
    depth, colour, interlaced = data[24], data[25], data[28]
    if depth != 8 or colour not in _SAMPLES or interlaced:
        return None
    while at + 12 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + n], np.uint8).reshape(-1, 3)
        at += 12 + n
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
        found = _unfiltered(raw, height, width, _SAMPLES[colour])
        return palette[found[:, :, 0]] if colour == 3 else found[:, :, :3] if colour in (2, 6) else found[:, :, :1]
    except (zlib.error, ValueError, IndexError, TypeError) as e:
        raise NoPicture("bad pixels") from e


def luminance(data: bytes) -> np.ndarray | None:
    """The luminance of a whole PNG's pixels, 0 to 255; null where `pixels` is."""
    found = pixels(data)
    if found is None:
        return None
    return (found @ _WEIGHTS + 500) // 1000 if found.shape[2] == 3 else found[:, :, 0].astype(np.int64)


def capped(data: bytes, megapixels: float) -> tuple[bytes, int, int] | None:
    """A PNG of more than `megapixels` scaled down to that, as PNG, with its new width and height; null if its pixels can't be decoded."""
    if not data.startswith(_PNG) or (found := pixels(data)) is None:
        return None
    scale = (megapixels / (found.shape[0] * found.shape[1] / 1e6)) ** 0.5
    height, width = (max(1, int(n * scale)) for n in found.shape[:2])
    small = np.stack([_scaled(found[:, :, c], height, width) for c in range(found.shape[2])], 2)
    lines = np.zeros((height, 1 + width * found.shape[2]), np.uint8)
    lines[:, 1:] = np.clip(np.rint(small), 0, 255).astype(np.uint8).reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if found.shape[2] == 3 else 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b""), width, height


def _scaled(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The means of `rows` x `columns` equal tiles, of which each may cover parts of pixels."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, 0)])
        at = np.arange(n + 1) * a.shape[0] / n
        low = np.minimum(at.astype(int), a.shape[0] - 1)
        edges = sums[low] + (at - low)[:, None] * a[low]
        return np.diff(edges, axis=0) * n / a.shape[0]

    return along(along(plane.astype(float), rows).T, columns).T


def phash(data: bytes) -> str | None:
    """A perceptual hash of a PNG in 16 hexadecimal digits: which of the lowest frequencies of its luminance exceed their median.

    Null for other formats, whose pixels are not decoded. Scaled copies share it but for a few bits.
    """
    if not data.startswith(_PNG) or (grey := luminance(data)) is None:
        return None
    k = np.arange(_LOW)[:, None]
    cosines = np.cos(np.pi * k * (2 * np.arange(_SIDE) + 1) / (2 * _SIDE))
    low = (cosines @ _scaled(grey, _SIDE, _SIDE) @ cosines.T).ravel()
    bits = low > np.median(low)
    return f"{int(''.join('01'[int(b)] for b in bits), 2):016x}"


@pandas_udf(BooleanType())
def damaged(content: pd.Series) -> pd.Series:
    """Whether a file's bytes are no whole picture."""

    def bad(data: bytes) -> bool:
        try:
            examined(bytes(data))
        except NoPicture:
            return True
        return False

    return content.map(bad, na_action="ignore")
