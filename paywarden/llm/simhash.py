"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit for each of 64 positions, set when over half of the shingle hashes have it. Distinct
fingerprints (copies are folded first) are dealt to tasks by bits that linked ones share: the 64 bits are cut in b
blocks, and two that differ in at most four bits agree in b - 4 of them at least, so a shard for each choice of b - 4
blocks and their bits holds every link. b grows with the number of distinct fingerprints (`layout`), so that shards
stay small. Within a shard the fingerprints, sorted by their bits, are a binary trie whose nodes are ranges. Pairs of nodes are walked together level by level; each pair carries the bits
in which its sides differ so far, and falls away when that passes the budget. Links are united as they are found,
so a group returns a star per component and never its pairs.

Hot groups: copies are folded by a map-side aggregate; a shard above `chunk` fingerprints is cut in chunks, and each
pair of chunks is a group of its own, so a task holds at most two chunks. Nothing is dropped.

Defined cases: null or empty text (or only white space) has fingerprint zero, which is linked like any other; null
doc_id rows keep their fingerprint and join a component whose id ignores nulls (null if no id is known); repeated
rows stay; an empty table gives an empty result; extra columns of the input are left alone.

Near-duplicates by similarity (`similar_classes`, `drop_near_duplicates`): two sets of shingles with a Jaccard
similarity of 0.8 differ in 0.15 of a fingerprint's bits, too many for one budget of 64 bits. So a set has a longer
fingerprint, with several tables of keys (runs of its bits). In a table, sets of one key are a shard, walked as a trie over the 64 bits that follow
the key. The walk's budget follows the depth (`walk_limits`), so that strangers fall away early; the 64 bits after
those are checked too. What is found are candidates only, as stars per shard; whole sets decide (shingle_sets).
`wide_layout` takes key length and number of tables from the number of sets, so that shards stay small and a pair at 0.8 is missed with a chance of about MISS;
pairs above are missed more rarely. A hot shard is settled by pivots and chunk pairs like a hot component of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, components, find_roots, flat_bytes, free_name, group_edges, keep_rows, let_go, made, slices, stars, store, unite, whole_groups, with_row_id
from .shingle_sets import chunk_pairs, set_classes, settle, shingles

#: How often the bits of two sets of similarity 0.8 differ, at most: arccos(0.8 / 0.9) / pi is 0.152, small sets come to 0.16.
DIFFER = 0.16
#: The chance that such a pair is in no shard together.
MISS = 2e-5
#: Added to a shingle's hash before it is mixed anew for each word of a longer fingerprint.
SEEDS = np.random.default_rng(21).integers(0, 1 << 63, 1 << 10, dtype=np.int64).astype(np.uint64)

def layout(n: int, budget: int, chunk: int) -> list[list[tuple[int, int]]]:
    """Bit ranges whose equality makes a shard, for each choice of blocks; the number of blocks that costs n fingerprints least copies."""

    def choices(blocks: int) -> list[list[tuple[int, int]]]:
        at = [64 * i // blocks for i in range(blocks + 1)]
        return [[(at[i], at[i + 1]) for i in c] for c in combinations(range(blocks), blocks - budget)]

    def copies(choice: list[list[tuple[int, int]]]) -> float:
        bits = min(sum(hi - lo for lo, hi in ranges) for ranges in choice)
        return len(choice) * max(1.0, n / (chunk * 2.0**bits))

    return min((choices(budget + 1 + more) for more in range(4)), key=copies)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text: ASCII lower case, white-space words, shingles of `words` words, repeats counted."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    if n <= 1:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    counts, total = np.zeros(64, np.int64), n
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist())],
            dtype=np.uint64,
        )
        counts += bit_counts(hashes)
    return int(sum(1 << i for i in range(64) if 2 * counts[i] > total))


def bit_counts(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """How many of the hashes, of `words` words each, have each of the bits."""
    out = np.zeros(64 * words, np.int64)
    cells = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
    for at in range(0, len(cells), 255):  # sums of 255 bits fit a byte
        out += cells[at : at + 255].sum(axis=0, dtype=np.uint8)
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `fp` (the fingerprint's bits as a signed long) of each row."""
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for b in slices(whole, "t"):
                texts = b.column("t").cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(x or b"", words) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(fp)], [*names, "fp"])

    out = src.mapInArrow(run, f"{schema}, fp long" if names else "fp long")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "fp")


def trie_links(values: np.ndarray, edges: np.ndarray, budget: int | list[int], side: np.ndarray | None = None, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values (uint64, sorted within each group of `edges`) that differ in at most budget bits.

    budget: where a list of 64, how many of the first 1, 2 ... 64 bits may differ; pairs compared leaf by leaf are held to the last only.
    side: where given, only pairs of different sides are wanted; others may come as well.
    A node of the trie is a range of equal leading bits. The frontier holds pairs of nodes with the bits in which
    they differ; a child pair is dropped as soon as its bits pass the budget. Small pairs of nodes are compared leaf
    by leaf. The frontier is a stack of bounded pieces, so memory does not follow the number of pairs.
    """
    limits = [budget] * 64 if isinstance(budget, int) else budget
    ones = [np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64) for d in range(64)]
    a, b = edges[:-1], edges[1:]
    big = b - a > 1
    a, b = a[big], b[big]
    stack = [(0, a, b, a, b, np.zeros(len(a), np.int64))] if len(a) else []
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > most:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, diff))), (depth, *(x[half:] for x in (a0, a1, b0, b1, diff)))]
            continue
        leaf = (a1 - a0) * (b1 - b0) <= 16 if depth < 64 else np.ones(len(a0), bool)
        if leaf.any():
            yield from _leaves(values, *(x[leaf] for x in (a0, a1, b0, b1)), limits[-1], most)
            a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        o = ones[depth]
        am, bm = a1 - (o[a1] - o[a0]), b1 - (o[b1] - o[b0])
        own = a0 == b0
        parts = []
        for x0, x1, y0, y1, step in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            d = diff + step
            ok = (x1 > x0) & (y1 > y0) & (d <= limits[depth])
            if step and x0 is am:
                ok &= ~own  # the mirror of the pair before
            ok &= ~((x0 == y0) & (x1 - x0 == 1))
            parts.append(tuple(x[ok] for x in (x0, x1, y0, y1, d)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def _leaves(values, a0, a1, b0, b1, budget, most):
    na, nb = a1 - a0, b1 - b0
    size = na * nb
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * most)))
        rep = np.repeat(np.arange(at, upto), size[at:upto])
        k = np.arange(len(rep)) - np.repeat(ends[at:upto] - size[at:upto] - (ends[at - 1] if at else 0), size[at:upto])
        i, j = a0[rep] + k // nb[rep], b0[rep] + k % nb[rep]
        fine = (i < j) | (a0[rep] != b0[rep])
        i, j = i[fine], j[fine]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        yield i[near], j[near]
        at = upto


def near_links(fps: DataFrame, budget: int = 4, chunk: int = 4096) -> DataFrame:
    """Edges (u, v) that span each component of `fps` (distinct longs, column fp) linked at <= budget differing bits."""
    if not 0 <= budget <= 8:
        raise ValueError("a budget of 0 to 8 bits")
    bits = lambda lo, hi: F.shiftrightunsigned("fp", 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    keys = [F.xxhash64(F.lit(i), *[bits(*x) for x in ranges]) for i, ranges in enumerate(layout(fps.count(), budget, chunk))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("block"))
    hot = keyed.groupBy("block").count().where(F.col("count") > chunk).select("block", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    hot = store(hot, "hot")  # joins with a stored side can be split where a key is hot
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))
    dealt = (
        keyed.join(hot, "block", "left")
        .select("fp", "block", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        .select("fp", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp"):
            keys, values = t.column("grp").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((values, keys))
            keys, values = keys[order], values[order]
            parent = np.arange(len(values))
            for a, b in trie_links(values, group_edges(keys), budget):
                parent = unite(parent, a, b)
            child = np.flatnonzero(find_roots(parent) != np.arange(len(parent)))
            signed = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[parent[child]])], ["u", "v"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(run, "u long, v long")


def near_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 4, budget: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp, root, component_id) of each row; component_id is the smallest id reachable by links, root the component's smallest fingerprint."""
    rows = store(fingerprints(docs, text, words, (id_col, *keep)), "fingerprints")
    least = store(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct")
    roots = components(near_links(least.select("fp"), budget))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = store(rooted, "rooted")
    classes = store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "classes")
    of = store(rooted.join(classes, "root").select("fp", "root", "component_id"), "of")
    return rows.join(of, "fp", "left").select(id_col, *keep, "fp", "root", "component_id")


def hex_of(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def walk_limits(differ: float = DIFFER, spread: float = 2.5) -> list[int]:
    """How many of the first 1, 2 ... 64 bits may differ: the mean at `differ` and so many standard deviations."""
    return [int(differ * k + spread * math.sqrt(differ * (1 - differ) * k)) for k in range(1, 65)]


def _passes(differ: float, limits: list[int]) -> float:
    """The chance that bits which differ so often keep all limits."""
    at = np.array([1.0])
    for limit in limits:
        at = (np.append(at, 0) * (1 - differ) + np.append(0, at) * differ)[: limit + 1]
    return float(at.sum())


def wide_layout(n: int, shard: int = 1024) -> tuple[int, int, int]:
    """(bits of a key, tables, words of a fingerprint) for n sets: shards of `shard` sets about, and as many tables as MISS asks for."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / shard)))
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** bits) * _passes(DIFFER, walk_limits())))
    return bits, tables, max(4, -(-tables * bits // 64))


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint of 64 * words bits of a set of shingle hashes; a bit is 1 if set in over half of the mixed hashes."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 2048):
        z = hashes[at : at + 2048, None] + SEEDS[None, :words]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        counts += bit_counts(z ^ (z >> np.uint64(31)), words)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def wide_fingerprints(docs: DataFrame, text: str, keep: tuple[str, ...], words: int, width: int) -> DataFrame:
    """The columns `keep`, and set (a hash of the whole set of shingles), n (its size) and wide (a fingerprint of `width` words) of each row."""
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for b in slices(whole, "t"):
                sets = [shingles(x or b"", words) for x in b.column("t").cast(pa.binary()).to_pylist()]
                whose = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                wide = pa.array([wide_fingerprint(s, width) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(whose), pa.array([len(s) for s in sets], pa.int64()), wide], [*names, "set", "n", "wide"])

    out = src.mapInArrow(run, f"{schema}, set long, n long, wide binary")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "set", "n", "wide")


def _window(wide: np.ndarray, at: int) -> np.ndarray:
    """The 64 bits from bit `at` on of each row of words, which goes on with its first word after its last."""
    word, off = divmod(at, 64)
    a, b = wide[:, word % wide.shape[1]], wide[:, (word + 1) % wide.shape[1]]
    return a if not off else a << np.uint64(off) | b >> np.uint64(64 - off)


def wide_links(prints: DataFrame, bits: int, tables: int, chunk: int = 1 << 13, differ: float = DIFFER) -> DataFrame:
    """Edges (u, v) between sets of prints(set, wide) that span the candidates of each shard; a shard is a table and a key of `bits` bits."""
    limits, both = walk_limits(differ), int(128 * differ + 3.5 * math.sqrt(128 * differ * (1 - differ)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw, _ = flat_bytes(b.column("wide"))
                wide = raw.view(">u8").astype(np.uint64).reshape(b.num_rows, -1)
                ends = pa.array(np.arange(0, 16 * b.num_rows + 1, 16, dtype=np.int32)).buffers()[1]
                for i in range(tables):
                    root = (_window(wide, i * bits) >> np.uint64(64 - bits)) | np.uint64(i << 40)
                    h = np.stack([_window(wide, i * bits + bits), _window(wide, i * bits + bits + 64)], axis=1)
                    h = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(h.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), b.column("set"), h], ["root", "set", "h"])

    keyed = prints.select("set", "wide").mapInArrow(deal, "root long, set long, h binary")
    hot = store(keyed.groupBy("root").count().where(F.col("count") > chunk).select("root"), "hot")
    dealt, found = keyed.join(hot, "root", "left_anti").select("set", "h", F.col("root").alias("grp")), None
    if not hot.isEmpty():
        weight = 512  # the least that settle and chunk_pairs count for a row
        open_ = store(keyed.join(hot, "root").select("root", "set", F.lit(weight).cast("long").alias("n"), "h", F.col("set").alias("mate")), "open")
        rows, found = settle(open_, lambda a, b: int(np.bitwise_count(a ^ b).sum()) <= both, weight * chunk)
        dealt = dealt.unionByName(chunk_pairs(rows, weight * chunk).select("set", "h", "grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in whole_groups(batches, "grp"):
            keys, names = t.column("grp").to_numpy(), t.column("set").to_numpy()
            raw, _ = flat_bytes(t.column("h").combine_chunks())
            pair = raw.view(np.uint64).reshape(-1, 2)
            order = np.lexsort((pair[:, 0], keys))
            keys, names, first, then = keys[order], names[order], pair[order, 0], pair[order, 1]
            parent = np.arange(len(keys))
            for a, b in trie_links(first, group_edges(keys), limits):
                near = np.bitwise_count(first[a] ^ first[b]) + np.bitwise_count(then[a] ^ then[b]) <= both
                parent = unite(parent, a[near], b[near])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(parent, names)], ["u", "v"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(run, "u long, v long")
    return out if found is None else out.unionByName(found)


def similar_classes(docs: DataFrame, rid: str, text: str = "text", keep: tuple[str, ...] = (), words: int = 5, least: float = 0.8, chunk: int = 1 << 19) -> DataFrame:
    """(rid, *keep, root) of each row; rows whose sets of shingles are joined by links of similarity >= least have the same root. rid is unique and the same at each scan."""
    if least < 0.8:
        raise ValueError("the tables are laid out for similarities from 0.8")
    bits, tables, width = wide_layout(docs.count())
    rows = store(wide_fingerprints(docs, text, (rid, *keep), words, width), "fingerprints")
    one = store(rows.groupBy("set").agg(F.min(rid).alias("rid"), F.min("n").alias("n"), F.any_value("wide").alias("wide")), "distinct")
    maybe = components(wide_links(one.where("n > 0"), bits, tables))
    return set_classes(docs, rows, one, maybe, rid, text, keep, words, least, chunk)


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of docs, one of each near-duplicate class: that with the smallest id (then the first stored; null ids last).

    Classes are joined by links of Jaccard similarity >= `similarity` of whole shingle sets, among the candidates that
    the fingerprints' tries give (`similar_classes`).
    """
    rid = free_name(docs, "rid")
    rows = with_row_id(docs, rid)
    since = made()
    plain = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("t"))
    classes = store(similar_classes(plain, "rid", "t", ("id",), words, similarity), "rows")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("rid").alias("c"))
    best = classes.groupBy("root").agg(F.min(rank).alias("best")).select("root", F.col("best.c").alias("kept"))
    best = store(best, "best")
    upto = made()
    gone = store(classes.join(best, "root").where("rid <> kept").select(F.col("rid").alias(rid)), "gone")
    clear(docs.sparkSession, since, upto=upto)  # all but gone
    return keep_rows(rows, gone, rid, but=True).select(*docs.columns)
