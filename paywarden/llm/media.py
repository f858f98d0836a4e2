"""Media columns: PNG images in binary columns, and hashes of their low frequencies.

Writing: rows of 8-bit grey samples, filtered, deflated, in chunks with their CRC. Reading: each chunk's CRC is
tested, the stream inflated and the rows unfiltered with numpy (None, Sub and Up as whole-array sums, Average and
Paeth along each row), then a 64-bit hash is made: the picture is brought to 32 x 32 by means, transformed by cosines,
and each of the lowest 8 x 8 coefficients (but the mean) says whether it is above their median.

Defined cases: null or empty text is one row of spaces; equal texts give equal bytes and hashes; damaged images raise
ValueError; images of other colour types or depths raise ValueError; a picture with fewer than 32 rows repeats them;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MAGIC, WIDTH = b"\x89PNG\r\n\x1a\n", 192
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """Rows with their filter byte; samples are one byte."""
    h, w = image.shape
    left, up, corner = np.zeros_like(image), np.zeros_like(image), np.zeros_like(image)
    left[:, 1:], up[1:], corner[1:, 1:] = image[:, :-1], image[:-1], image[:-1, :-1]
    if kind == NONE:
        body = image
    elif kind == SUB:
        body = image - left
    elif kind == UP:
        body = image - up
    elif kind == AVERAGE:
        body = image - ((left.astype(np.int16) + up) // 2).astype(np.uint8)
    else:
        body = image - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
    return np.concatenate([np.full((h, 1), kind, np.uint8), body], axis=1)


def _paeth(a, b, c):
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Samples of rows that begin with their filter byte."""
    kinds, body = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and (kinds > PAETH).any():
        raise ValueError("unknown filter")
    edges = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]])
    for a, b in zip(edges, edges[1:]):  # runs of rows with one filter
        kind = kinds[a] if b > a else NONE
        if kind == SUB:
            body[a:b] = np.cumsum(body[a:b], axis=1, dtype=np.uint8)
        elif kind == UP:
            if a:
                body[a] += body[a - 1]
            body[a:b] = np.cumsum(body[a:b], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                up = body[y - 1].astype(int).tolist() if y else [0] * body.shape[1]
                row, left, corner = body[y].tolist(), 0, 0
                for x in range(len(row)):
                    if kind == AVERAGE:
                        left = (row[x] + (left + up[x]) // 2) & 255
                    else:
                        p, q, r = abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)
                        guess = left if p <= q and p <= r else up[x] if q <= r else corner
                        corner = up[x]
                        left = (row[x] + guess) & 255
                    row[x] = left
                body[y] = row
    return body


def to_png(image: np.ndarray, kind: int = UP, level: int = 1) -> bytes:
    h, w = image.shape
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(image, kind).tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; every checksum is tested."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("the file ends within a chunk")
        n = struct.unpack_from(">I", data, at)[0]
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
            size = h, w
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if size is None:
        raise ValueError("no header")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    return unfiltered(raw.reshape(size[0], size[1] + 1))


_K = np.arange(32)
_COS = np.cos(np.pi * (2 * _K[None] + 1) * _K[:8, None] / 64)


def low_hash(image: np.ndarray) -> int:
    """64-bit hash of the lowest cosine frequencies of a grey picture."""
    h, w = image.shape
    rows = np.add.reduceat(image.astype(np.float64), np.arange(32) * h // 32, axis=0) if h >= 32 else image[np.arange(32) * h // 32].astype(np.float64)
    if h >= 32:
        rows /= np.diff(np.append(np.arange(32) * h // 32, h))[:, None]
    small = np.add.reduceat(rows, np.arange(32) * w // 32, axis=1) / np.diff(np.append(np.arange(32) * w // 32, w))
    low = np.round((_COS @ small @ _COS.T).ravel(), 6)  # an even picture has no frequencies, not those of rounding
    bits = low > np.median(low[1:])
    bits[0] = False
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def payload(text: bytes, width: int = WIDTH) -> bytes:
    """The bytes, filled with spaces to a positive multiple of width."""
    return text + b" " * (max(width, -(-len(text) // width) * width) - len(text))


def _mapped(src: DataFrame, column: str, keep: list[str], schema: str, labels: list[str], make) -> DataFrame:
    kept = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, column):
                rows = [make(x or b"") for x in b.column(column).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], *[pa.array(c) for c in zip(*rows)]], [*keep, *labels])

    return src.mapInArrow(run, kept + schema)


def to_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_bytes and media: the text as a PNG."""
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    made = _mapped(src, "t", names, "n_bytes long, media binary", ["n_bytes", "media"], lambda t: (len(t), to_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH))))
    return made.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", "media")


def features(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns `keep` and what the stored images hold: payload and media sizes and digests, and the hash in hex."""
    names = [f"k{i}" for i in range(len(keep))]
    src = media.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], "media")

    def make(data: bytes) -> tuple:
        image = from_png(data)
        body = image.tobytes()
        return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{low_hash(image):016x}"

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    labels = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    made = _mapped(src, "media", names, schema, labels, make)
    return made.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *labels)
