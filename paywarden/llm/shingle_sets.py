"""Sets of word shingles: which of those that may be alike have a Jaccard similarity of at least s, exactly.

Candidates come from elsewhere (simhash, minhash) as components (a root per set). Only their texts are read again, and
within a component sets are joined exactly (a link needs a common shingle among the rarest 1 - s of either set, then
both whole sets are compared), so no link rests on an estimate.

Hot components: in one above `chunk` shingles some pivots are compared with all members, dealt over many tasks, and those
linked to one are settled. Pivots that share a linked member are one class, whose members need no comparing among
themselves. That goes on with further pivots while much is left and they settle a fair part of it. What is left, and each
large class, is cut in chunks, small classes share chunks, and each pair of chunks but those within a class is a group of
its own, so a task holds at most about two chunks (or two texts, where those are longer). So a group of near copies of one
text, however large, costs in proportion to its size. Nothing is dropped.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and white-space texts have the empty
set, which is equal to itself and like no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, group_edges, keep_rows, let_go, slices, stars, store, unite, whole_groups


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: ASCII lower case, white-space words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    if n <= 1:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n))


def link_sets(flat: np.ndarray, edges: np.ndarray, least: float, label: np.ndarray | None = None) -> np.ndarray:
    """A label per set (sets are runs of flat, cut at edges): equal where links of similarity >= least join them.

    label: what is known before; sets of equal labels are not compared with each other.
    """
    g, sizes = len(edges) - 1, np.diff(edges)
    label = np.arange(g) if label is None else label.copy()
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    whose = np.repeat(np.arange(g), sizes)
    token = rank[token]
    token = token[np.lexsort((token, whose))]  # rare shingles first in each set
    first = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    head = np.arange(len(token)) - edges[whose] < first[whose]
    by = np.argsort(token[head], kind="stable")
    heads, owner = token[head][by], whose[head][by]
    begin, end = np.searchsorted(heads, np.arange(len(count))), np.searchsorted(heads, np.arange(len(count)), side="right")
    mark = np.zeros(len(count), bool)
    for i in range(g):
        own = token[edges[i] : edges[i + 1]]
        runs = [owner[begin[t] : end[t]] for t in own[: first[i]].tolist() if end[t] - begin[t] > 1]
        if not runs:
            continue
        js = np.unique(np.concatenate(runs))
        js = js[(js > i) & (label[js] != label[i]) & (np.minimum(sizes[js], sizes[i]) >= least * np.maximum(sizes[js], sizes[i]) - 1e-9)]
        if not len(js):
            continue
        mark[own] = True
        for part in np.array_split(js, -(-len(js) // 256)):
            n = sizes[part]
            upto = np.cumsum(n)
            at = np.repeat(edges[part] - (upto - n), n) + np.arange(upto[-1])
            both = np.add.reduceat(mark[token[at]].astype(np.int64), upto - n)
            for j in part[both >= least * (n + sizes[i] - both) - 1e-9].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
        mark[own] = False
    return label


SETS = "root long, set long, n long, h binary, mate long"


def _weight():
    """A set's shingles, at least 512, so that a chunk also has at most chunk / 512 sets."""
    return F.greatest("n", F.lit(512))


def pivot_round(open_: DataFrame, hot: DataFrame, alike: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """open_ rows of hot(root, pivots, parts) with links: the pivots that a set is linked to, itself included if it is one.

    A root's rows are dealt in parts, and each part gets the pivots' sets once, before its rows.
    """
    mine = open_.join(hot, "root")
    first = store(mine.where(F.array_contains("pivots", F.col("set"))).select("root", "parts", "set", "h"), "pivots")
    first = first.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), "set", F.lit(0).cast("long").alias("n"), "h")
    rows = mine.select("root", F.pmod(F.xxhash64("set", F.lit("part")), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("turn"), "set", "n", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held, pivots = None, []
        for b in batches:
            out = []
            names, sets = b.column("set").to_pylist(), b.column("h")
            keys = list(zip(b.column("root").to_pylist(), b.column("part").to_pylist()))
            for i, turn in enumerate(b.column("turn").to_pylist()):
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if keys[i] != held:
                    held, pivots = keys[i], []
                if turn == 0:
                    pivots.append((names[i], own.copy()))
                else:
                    out.append((i, sorted(name for name, p in pivots if alike(own, p))))
            if out:
                at, links = zip(*out)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(at)) for c in ("root", "set", "n", "h")], pa.array(links, pa.list_(pa.int64()))], ["root", "set", "n", "h", "links"])

    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(rows).repartition(n, "root", "part").sortWithinPartitions("root", "part", "turn")
    return store(dealt.mapInArrow(run, "root long, set long, n long, h binary, links array<long>"), "round")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, as sorted distinct numbers, have a similarity of at least `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9 or not len(b):
        return False
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def settle(open_: DataFrame, alike: Callable[[np.ndarray, np.ndarray], bool], chunk: int, rounds: int = 6, pivots: int = 16, fair: int = 16) -> tuple[DataFrame, DataFrame]:
    """(the rows with `class`, edges): sets linked to a pivot are in the class of all pivots that shared sets join; null is open.

    A root of which a round settles less than 1 / fair gets no further pivots: it is no large group of near copies any more.
    """
    columns, settled, left = open_.columns, None, []
    for i in range(rounds):
        picked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("set", F.lit(i)).alias("x"), "set"))), 1, pivots), lambda p: p["set"])
        hot = open_.groupBy("root").agg(F.sum(_weight()).alias("w"), F.count("*").alias("rows")).where(F.col("w") > chunk)
        hot = store(hot.select("root", "rows", F.ceil(F.col("w") / chunk).cast("int").alias("parts")), "hot")
        if hot.isEmpty():
            break
        few = F.pmod(F.xxhash64("set", F.lit(f"p{i}")), F.lit(1 << 30)) <= F.lit(4 * pivots * (1 << 30)) / F.col("rows")  # a sample of about 4 * pivots
        hot = store(open_.join(hot, "root").where(few).groupBy("root", "parts").agg(picked.alias("pivots")), "pivots")
        met = pivot_round(open_, hot, alike)
        linked = met.where(F.size("links") > 0)
        settled = linked if settled is None else settled.unionByName(linked)
        rest = met.where(F.size("links") == 0).withColumn("mate", F.col("set"))
        going = met.groupBy("root").agg(F.count_if(F.size("links") > 0).alias("found"), F.count("*").alias("rows"))
        going = store(going.where(F.col("found") * fair >= F.col("rows")).select("root"), "going")
        left += [open_.join(hot, "root", "left_anti").select(*columns), rest.join(going, "root", "left_anti").select(*columns)]
        open_ = store(rest.join(going, "root", "left_semi").select(*columns), "open")
    for part in left:
        open_ = open_.unionByName(part)
    if settled is None:
        return open_.withColumn("class", F.lit(None).cast("long")), None
    pairs = settled.where(F.size("links") > 1).select(F.explode(F.transform(F.slice("links", 2, pivots), lambda v: F.struct(v.alias("u"), F.get("links", F.lit(0)).alias("v")))).alias("e")).select("e.*").distinct()
    joined = components(pairs)  # of pivots
    settled = _classed(settled, joined)
    rows = store(open_.withColumn("class", F.lit(None).cast("long")).unionByName(settled.select(*columns, "class")), "settled")
    edges = rows.where("class is not null and set <> class").select(F.col("set").alias("u"), F.col("class").alias("v"))
    return rows, edges


def _classed(settled: DataFrame, joined: DataFrame) -> DataFrame:
    """settled with mate, and class: the least pivot of those that shared sets join to the row's first one."""
    of = joined.select(F.col("node").alias("p"), F.col("root").alias("q"))
    out = settled.withColumn("first", F.get("links", F.lit(0)))
    return out.join(of, F.col("first") == F.col("p"), "left").withColumn("class", F.coalesce("q", "first")).withColumn("mate", F.col("class"))


def chunk_pairs(rows: DataFrame, chunk: int) -> DataFrame:
    """rows once for each pair of chunks of their root that they are in, but for pairs within a class. Classes of up to a quarter of a chunk share chunks."""
    per = rows.groupBy("root", "class").agg(F.sum(_weight()).alias("w"))  # as many as there were pivots, and one
    small = F.col("class").isNotNull() & (F.col("w") * 4 <= chunk)
    per = per.withColumn("m", F.when(small, 0).otherwise(F.ceil(F.col("w") / chunk)).cast("int")).withColumn("s", F.when(small, F.col("w")).otherwise(0))
    root = Window.partitionBy("root")
    before = root.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("at", F.sum("m").over(before) - F.col("m")).withColumn("bin", F.floor((F.sum("s").over(before) - F.col("s")) / chunk)).withColumn("own", F.sum("m").over(root))
    per = per.withColumn("all", F.col("own") + F.coalesce(F.max(F.when(small, F.col("bin") + 1)).over(root), F.lit(0)))
    per = per.withColumn("at", F.when(small, F.col("own") + F.col("bin")).otherwise(F.col("at"))).withColumn("m", F.when(small, 1).otherwise(F.col("m")))
    per = store(per.select(F.col("root").alias("r"), F.col("class").alias("c"), "m", "at", "all", (small | F.col("class").isNull()).alias("mixed")), "chunks")
    out = rows.join(per, (rows["root"] == per["r"]) & rows["class"].eqNullSafe(per["c"]))
    out = out.withColumn("own", F.col("at") + F.pmod(F.xxhash64("set"), F.col("m")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda o: F.col("mixed") | (o < F.col("at")) | (o >= F.col("at") + F.col("m")))
    out = out.withColumn("other", F.explode(others))
    return out.select("set", "h", "mate", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))


def set_links(texts: DataFrame, words: int, least: float, chunk: int, rounds: int = 6) -> DataFrame:
    """Edges (u, v) that span the components of texts(root, set, n, t), which are linked within a root only."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for b in slices(whole, "t"):
                sets = [shingles(x or b"", words).tobytes() for x in b.column("t").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("root"), b.column("set"), b.column("n"), pa.array(sets, pa.binary()), b.column("set")], ["root", "set", "n", "h", "mate"])

    sets = lambda t: t.select("root", "set", "n", "t").mapInArrow(hashes, SETS)
    hot = texts.groupBy("root").agg(F.sum(_weight()).alias("w")).where(F.col("w") > chunk)
    hot = store(hot.select("root"), "hot")  # joins with a stored side can be split where a key is hot
    dealt, found = sets(texts.join(hot, "root", "left_anti")).select("set", "h", "mate", F.xxhash64("root").alias("grp")), None
    if not hot.isEmpty():
        rows, found = settle(store(sets(texts.join(hot, "root", "left_semi")), "sets"), lambda a, b: _alike(a, b, least), chunk, rounds)
        dealt = dealt.unionByName(chunk_pairs(rows, chunk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in whole_groups(batches, "grp", 1 << 20, lambda b: b.nbytes // 8):
            keys, names, mates, column = t.column("grp").to_numpy(), t.column("set").to_numpy(), t.column("mate").to_numpy(), t.column("h").combine_chunks()
            parent = np.arange(len(keys))
            edges = group_edges(keys)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a > 1:
                    held = [np.frombuffer(x, np.uint64) for x in column.slice(a, b - a).to_pylist()]
                    _, first, of = np.unique(mates[a:b], return_index=True, return_inverse=True)
                    label = link_sets(np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]), least, first[of])
                    parent = unite(parent, np.arange(a, b), a + label)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(parent, names)], ["u", "v"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(run, "u long, v long")
    return out if found is None else out.unionByName(found)


def set_classes(docs: DataFrame, rows: DataFrame, one: DataFrame, maybe: DataFrame, rid: str, text: str, keep: tuple[str, ...], words: int, least: float, chunk: int) -> DataFrame:
    """(rid, *keep, root) of `rows`, each of which has a set; `one` has a row per set, `maybe` (node, root) the components of sets that may be linked."""
    maybe = store(one.join(maybe, one.set == maybe.node).select("rid", "set", "n", "root"), "candidates")
    texts = keep_rows(docs.select(F.col(rid).alias("rid"), F.col(text).alias("t")), maybe, "rid")  # so that only their texts are dealt out
    texts = texts.join(maybe, "rid").select("root", "set", "n", "t")
    roots = components(set_links(store(texts, "texts"), words, least, chunk))
    of = store(one.join(roots, one.set == roots.node, "left").select("set", F.coalesce("root", "set").alias("root")), "of")
    return rows.join(of, "set").select(rid, *keep, "root")
