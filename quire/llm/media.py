"""Texts as lossless grey PNG images in a binary column, read back and hashed.

The payload (UTF-8 bytes padded with zeros to a positive multiple of the width)
is the image, one byte a pixel, ROW bytes a line, each stored under the filter of
least sum of absolute differences. Reading walks the chunks, tests every CRC,
inflates IDAT and undoes all five line filters in numpy. The
feature is a 64-bit hash of the image's low cosine frequencies.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
#: Lines that are filtered at a time.
LINES = 1 << 15


def payload(raw: bytes, row: int = ROW) -> bytes:
    return raw + bytes(-len(raw) % row if raw else row)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _pixels(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The Paeth predictor of left, above and upper left."""
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def tops(n: int, first: np.ndarray | None) -> np.ndarray:
    """Which of n lines begin an image; the first alone by default."""
    return np.arange(n) == 0 if first is None else first


def residues(img: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The lines under each of the five filters."""
    left, corner = np.zeros_like(img), np.zeros_like(img)
    left[:, 1:], corner[:, 1:] = img[:, :-1], above[:, :-1]
    mean = ((left.astype(np.uint16) + above) // 2).astype(np.uint8)
    return np.stack([img, img - left, img - above, img - mean, img - _pixels(left, above, corner)])


def filtered(img: np.ndarray, kinds: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """Lines of one or more images with their filter byte before them: the given
    kinds, or for each line the one of least sum of absolute differences."""
    first, out = tops(len(img), first), np.empty((img.shape[0], img.shape[1] + 1), np.uint8)
    for lo in range(0, len(img), LINES):
        hi = min(len(img), lo + LINES)
        above = np.zeros_like(img[lo:hi])
        above[lo == 0 :] = img[max(lo - 1, 0) : hi - 1]
        above[first[lo:hi]] = 0
        every = residues(img[lo:hi], above)
        best = abs(every.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0) if kinds is None else kinds[lo:hi]
        out[lo:hi, 0], out[lo:hi, 1:] = best, every[best, np.arange(hi - lo)]
    return out


def unfiltered(lines: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Undoes the filters of one or more images of a width. A pixel needs its left,
    upper and upper left neighbours, so step t settles pixel t - y of every line y,
    of all images at once."""
    kinds, (n, row) = lines[:, 0], (lines.shape[0], lines.shape[1] - 1)
    if n and kinds.max() > 4:
        raise ValueError(f"line filter {kinds.max()}")
    if not kinds.any():
        return lines[:, 1:].copy()
    first = tops(n, first)
    y = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    order = np.argsort(y, kind="stable")
    # a column of zeros on the left and a line of zeros at the end stand for what lies outside
    wide = np.zeros((n + 1, row + 1), np.uint8)
    wide[:n, 1:] = lines[:, 1:]
    flat, y = wide.ravel(), y[order]
    # places of pixel t - y of a line and of the line above, less t
    at = order * (row + 1) + 1 - y
    up, kind = np.where(y > 0, (order - 1) * (row + 1), n * (row + 1)) + 1 - y, kinds[order]
    edge = np.searchsorted(y, np.arange(-row, y[-1] + row + 1)) if n else []
    for t in range(int(y[-1]) + row):
        lo, hi = edge[t + 1], edge[min(t + row + 1, len(edge) - 1)]
        own, over = at[lo:hi] + t, up[lo:hi] + t
        a, b, c = flat[own - 1], flat[over], flat[over - 1]
        mean = (a >> 1) + (b >> 1) + (a & b & 1)
        flat[own] += np.choose(kind[lo:hi], [np.uint8(0), a, b, mean, _pixels(a, b, c)])
    return wide[:n, 1:].copy()


def packed(lines: np.ndarray, level: int = 6) -> bytes:
    """The PNG of filtered lines."""
    head = struct.pack(">IIBBBBB", lines.shape[1] - 1, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def write_png(data: bytes, row: int = ROW, kinds: np.ndarray | None = None, level: int = 6) -> bytes:
    """kinds: the filter of each line, chosen by line by default."""
    return packed(filtered(np.frombuffer(data, np.uint8).reshape(-1, row), kinds), level)


def inflated(media: bytes) -> np.ndarray:
    """The filtered lines of an 8-bit grey PNG; refuses damaged files."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r} at {at}")
        if kind == b"IHDR":
            w, h, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError(f"format {form}")
            size = h, w + 1
        elif kind == b"IDAT":
            parts.append(data)
        ended, at = kind == b"IEND", at + 12 + n
    if size is None or not ended:
        raise ValueError("truncated file")
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size)


def read_png(media: bytes) -> np.ndarray:
    """The image of an 8-bit grey PNG."""
    return unfiltered(inflated(media))


def cosine_basis(n: int, m: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(m)[:, None] / (2 * n))


def cosine_hash(img: np.ndarray) -> str:
    """64 bits as hex: the sign, against their median, of the 8 x 8 lowest cosine
    frequencies of the image averaged to 32 x 32 cells."""
    def cells(a: np.ndarray) -> np.ndarray:
        n = len(a)
        edge = np.arange(GRID + 1) * n // GRID
        sums = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
        lo, hi = edge[:-1], np.maximum(edge[1:], edge[:-1] + 1)
        return (sums[hi] - sums[lo]) / (hi - lo)[:, None]

    basis = cosine_basis(GRID, LOW)
    low = (basis @ cells(cells(img).T).T @ basis.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, text: str = "text", id_: str = "doc_id", row: int = ROW) -> DataFrame:
    """One row a document: id, ``n_bytes``, ``media`` (the PNG), ``payload`` (the
    bytes read back from it) and ``feature``. A null text is an empty one, whose
    payload is one line of zeros. Equal texts give equal values, repeated rows each its
    own; a null id stays null. Texts are taken whole, at any length: one longer than a
    pass is a pass of its own. Other columns, whatever their names, are not read; an empty
    table gives none."""
    _base.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in _base.passes(batch, 1):
                n = np.diff(offs)
                data = [payload(raw[a:b].tobytes(), row) for a, b in zip(offs[:-1], offs[1:])]
                ends = np.cumsum([len(x) // row for x in data])
                first = np.zeros(ends[-1], bool)
                first[np.r_[0, ends[:-1]]] = True
                # filters are chosen and undone for all images of a pass together
                lines = filtered(np.frombuffer(b"".join(data), np.uint8).reshape(-1, row), None, first)
                media = [packed(x) for x in np.split(lines, ends[:-1])]
                images = np.split(unfiltered(np.concatenate([inflated(m) for m in media]), first), ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array([x.tobytes() for x in images], pa.binary()), pa.array([cosine_hash(x) for x in images], pa.string())],
                    ["id_", "n_bytes", "media", "payload", "feature"],
                )

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("id_"), F.col(text).alias("text_")).mapInArrow(run, f"id_ {kind}, n_bytes long, media binary, payload binary, feature string")
    return out.withColumnRenamed("id_", id_)
