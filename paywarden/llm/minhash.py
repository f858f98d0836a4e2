"""Near-duplicates by Jaccard similarity of word-shingle sets: MinHash bands find candidates, whole sets decide.

An operator of its own; the pipeline's stage takes its candidates from SimHash's tries (simhash.similar_classes).

A set's signature is ROWS * BANDS minima; two sets that agree in all rows of a band are candidates. At similarity s a
pair is missed with chance (1 - s**6)**32: 6e-5 at 0.8, 5e-7 at 0.85, less above. Equal sets are folded first. The
candidates' connected components (stars per band, never pairs) say which sets may be linked at all; shingle_sets joins
those exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, let_go, slices, store
from .shingle_sets import set_classes, shingles

ROWS, BANDS = 6, 32
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key (signed long) for each band of a set's signature."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(least, (FACTORS[:, None] * h[at : at + 1024] + SHIFTS[:, None]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(docs: DataFrame, text: str, keep: tuple[str, ...], words: int) -> DataFrame:
    """The columns `keep`, and set (a hash of the whole set), n (its size) and bands of each row."""
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for b in slices(whole, "t"):
                sets = [shingles(x or b"", words) for x in b.column("t").cast(pa.binary()).to_pylist()]
                whose = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate([bands(s) for s in sets])))
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(whose), pa.array([len(s) for s in sets], pa.int64()), keys], [*names, "set", "n", "bands"])

    out = src.mapInArrow(run, f"{schema}, set long, n long, bands array<long>")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "set", "n", "bands")


def near_classes(docs: DataFrame, rid: str, text: str = "text", keep: tuple[str, ...] = (), words: int = 5, least: float = 0.8, chunk: int = 1 << 19) -> DataFrame:
    """(rid, *keep, root) of each row; rows whose sets are joined by links of similarity >= least have the same root. rid is unique and the same at each scan."""
    rows = store(signatures(docs, text, (rid, *keep), words), "signatures")
    one = store(rows.groupBy("set").agg(F.min(rid).alias("rid"), F.min("n").alias("n"), F.any_value("bands").alias("bands")), "distinct")
    keyed = one.select("set", F.explode("bands").alias("band"))
    shared = store(keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("set").alias("v")).where("n > 1").select("band", "v"), "shared")
    maybe = components(keyed.join(shared, "band").select(F.col("set").alias("u"), "v"))
    return set_classes(docs, rows, one, maybe, rid, text, keep, words, least, chunk)
