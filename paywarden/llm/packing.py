"""Packing of documents into sequences along a space-filling curve.

Token ids are hashed into a count vector, the normed vector is projected to three dimensions by a fixed random matrix,
and the point's Hilbert key orders the documents: neighbours along the curve have similar tokens. A range sort by
(key, row number) gives each document its place; partition totals (one number a partition) turn places within a
partition into global ones. Documents are then laid end to end and cut at each sequence's end, so only the last
sequence has padding. Equal keys, however many, are dealt by row number.

Ids are those of the `tokenizers` library. Whole texts go through tiktoken with the merges of the same tokenizers file
where that file is a plain byte-level one (its merges in the order of their ids, no normalizer, no prefix space), which
gives the same ids in a quarter of the time; texts with a special token's text in them go to the library, and each
worker compares the two on its first texts and stays with the library where they differ.

Defined cases: null and empty texts are a single end id; repeated rows are separate documents; rows are told apart
by a row number, so null or equal ids do no harm; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, slices, store

BUCKETS, DIMS, BITS = 256, 3, 10


#: Fixed value: the pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _quick(path: str):
    """tiktoken's encoder with the merges of a byte-level tokenizers file, or None if the file says anything else."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    if file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or model.get("dropout"):
        return None
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; others from 256 on
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    try:
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    except (KeyError, ValueError):
        return None


class TextTokenizer:
    """ids of whole texts by a tokenizers file; made once per worker."""

    def __init__(self, path: str, tested: int = 1 << 17):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.quick = _quick(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.left = tested  # characters to be compared yet

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def one(self, text: str) -> list[int]:
        if self.quick is None or any(s in text for s in self.special):
            return self.whole(text)
        ids = self.quick(text)
        if self.left > 0:
            self.left -= len(text)
            if ids != self.whole(text):
                self.quick = None
                return self.whole(text)
        return ids

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each text's ids and `end`; where each begins and the length at the end)."""
        parts = []
        for t in texts:
            if t:
                parts.append(self.one(t))
            parts.append((end,))
        lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        ids = np.fromiter(itertools.chain.from_iterable(parts), np.int32, int(lengths.sum()))
        ends = np.cumsum([0, *lengths])[1:][np.cumsum([1 + bool(t) for t in texts]) - 1] if texts else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows x dimensions), each coordinate of `bits` bits."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Projector:
    """Hilbert keys of token-id lists: hashed counts, normed, times a fixed random matrix."""

    def __init__(self, seed: int = 7):
        self.matrix = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)) / 1.5
        self.of = ((np.arange(1 << 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)

    def keys(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        rows = len(edges) - 1
        if not rows:
            return np.zeros(0, np.int64)
        cell = self.of[ids & 0x1FFFF] + np.repeat(np.arange(rows), np.diff(edges)) * BUCKETS
        h = np.bincount(cell, minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(float)
        h /= np.maximum(np.sqrt((h * h).sum(axis=1, keepdims=True)), 1e-9)
        y = np.clip((h @ self.matrix + 2) / 4, 0, 1 - 1e-9)
        return hilbert((y * (1 << BITS)).astype(np.int64), BITS)


def tokenized(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], end: int) -> DataFrame:
    """A stored table: rid, the kept columns as k0.., key along the curve, n ids, ids as little-endian 16-bit numbers.

    Ids above 65535 need 32 bits; the vocabulary's size tells which of the two is written.
    """
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(path).get_vocab_size(), end + 1) > 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"), F.monotonically_increasing_id().alias("rid"))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names) + "rid long, key long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, project = per_worker(("tokenizer", path), lambda: TextTokenizer(path)), per_worker("projector", Projector)
        for whole in batches:
            for b in slices(whole, "t", 1 << 20):
                ids, edges = tok.encode([x or "" for x in b.column("t").to_pylist()], end)
                raw = memoryview(ids.astype(kind)).cast("B")
                w = kind.itemsize
                cells = [raw[a * w : z * w] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in names], b.column("rid"), pa.array(project.keys(ids, edges)), pa.array(np.diff(edges)), pa.array([bytes(c) for c in cells], pa.binary())],
                    [*names, "rid", "key", "n", "ids"],
                )

    return store(src.mapInArrow(run, schema), "ids")


def pack(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 2048, end: int = 1, with_ids: bool = True) -> DataFrame:
    """A row per piece: the kept columns, start, length, ids (array, if with_ids), ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    table = tokenized(docs, path, text, keep, end)
    names = [f"k{i}" for i in range(len(keep))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n)], ["rid", "part", "at", "n"])
            at = int(ends[-1]) if len(n) else at

    placed = store(
        table.select("key", "rid", "n").repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid").mapInArrow(place, "rid long, part long, at long, n long"), "places"
    )
    totals = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("n")).collect())  # a row per partition
    base, bases = 0, []
    for p, n in totals:
        bases.append((p, base))
        base += n
    if not bases:
        bases = [(0, 0)]
    placed = placed.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part").select("rid", (F.col("at") + F.col("base")).alias("at"))
    rows = table.select("rid", *names, "n", "ids").join(placed, "rid").drop("rid")
    schema = "".join(f"{n} {table.schema[n].dataType.simpleString()}, " for n in names) + "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ids", 1 << 22):
                n, at = b.column("n").to_numpy(), b.column("at").to_numpy()
                count = (at + n - 1) // length - at // length + 1
                row = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                seq = at[row] // length + k
                lo = np.maximum(seq * length, at[row])
                hi = np.minimum((seq + 1) * length, at[row] + n[row])
                cells = b.column("ids")
                ids = [np.frombuffer(cells[i].as_buffer(), np.dtype("<u2" if len(cells[i].as_buffer()) == 2 * m else "<u4")).astype("<u4") for i, m in enumerate(n.tolist())]
                start = lo - at[row]
                pieces = [ids[r][s : s + z] for r, s, z in zip(row.tolist(), start.tolist(), (hi - lo).tolist())]
                crc = [zlib.crc32(p) for p in pieces]
                arrays = [*[b.column(c).take(pa.array(row)) for c in names], pa.array(start), pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length)]
                labels = [*names, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    flat = np.concatenate(pieces).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)), pa.array(flat)))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, labels)

    out = rows.mapInArrow(cut, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[c for c in out.columns if c not in names])
