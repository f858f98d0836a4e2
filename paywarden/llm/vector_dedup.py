"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared only within a label (and a dimension). Equal vectors are folded first. Groups above `most`
vectors are split around pivots taken from their own rows until each shard fits a task. A vector is at home in the
cell of its nearest pivot and a guest in each earlier cell where a vector that it may link with can be at home: for
unit vectors within distance d, a pivot p is nearest to one of them only if the other's product with any pivot q
exceeds that with p by at most d * |q - p|. So every link has one shard that holds it, as a pair of homes or of a home
and a guest. A group that this does not shrink (near copies, or scattered vectors of many dimensions: children of over
half its rows, or of over twice its rows together) is cut in chunks instead, and each pair of chunks is compared whole.

In a shard, homes are searched by a graph: clusters around medoids overlap (each vector is in its two nearest), each
cluster gives its members a candidate list, robust pruning keeps diverse neighbours, the lists of both clusters are
united into one flat graph, and a greedy search from the nearest medoid finds each vector's place, from where a range
search expands over all neighbours above a slack. Found pairs are verified by cosine in double precision. An exact check
follows in every shard, over all its rows and not over a sample: what the graph did not reach is added, so no link
depends on the graph, on the order of rows, or on two shards. The slack is fixed and an expansion that would visit more
than `room` pairs for a block of queries ends there (dense shards), so the search costs in proportion to the rows and the
check a matrix product of at most `most` rows. Homes and guests are always compared in blocks of all pairs.

Shards return a row per vector: the number of its links and a root, never pairs.

Pivots: at most 2 * `fan` of each oversized shard, a bounded sample; all rows are indexed.

Defined cases: null labels, and vectors that are null, empty, zero or have null or non-finite parts, link with
nothing: n_links 0, component_id their own id; copies of a linked vector count one by one; a null id joins its class
and gets the class's smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, find_roots, group_edges, let_go, store, unite, whole_groups

DEGREE, CANDIDATES, ALPHA = 24, 48, 1.2


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (rows x degree, -1 where fewer) of unit vectors x, near ones first, each kept only if no kept one covers it."""
    m = len(x)
    k = min(candidates, m - 1)
    if k <= 0:
        return np.full((m, degree), -1)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    cand = np.argpartition(-near, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(near, cand, axis=1)
    by = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, by, axis=1), np.take_along_axis(sim, by, axis=1)
    open_ = np.ones(cand.shape, bool)
    out = np.full((m, degree), -1)
    rows = np.arange(m)
    for d in range(min(degree, k)):
        at = open_.argmax(axis=1)
        live = open_[rows, at]
        if not live.any():
            break
        pick = cand[rows, at]
        out[live, d] = pick[live]
        covered = alpha * np.sqrt(np.maximum(2 - 2 * near[pick[:, None], cand], 0)) <= np.sqrt(np.maximum(2 - 2 * sim, 0))
        open_ &= ~covered
        open_[rows, at] = False
    return out


def flat_graph(x: np.ndarray, size: int = 400, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency rows x 2*DEGREE with -1 for none, medoids) over overlapping clusters of unit vectors."""
    m = len(x)
    k = max(1, -(-m // size))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(m, k, replace=False)]
    for _ in range(4):
        of = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    sim = x @ centre.T
    own = np.argsort(-sim, axis=1, kind="stable")[:, : min(2, k)]
    graph = np.full((m, 2 * DEGREE), -1)
    medoids = []
    for c in range(k):
        for_c = np.flatnonzero((own == c).any(axis=1))
        if not len(for_c):
            continue
        medoids.append(for_c[sim[for_c, c].argmax()])
        for part in np.array_split(for_c, -(-len(for_c) // (4 * size))):  # an overgrown cluster is built in parts
            got = robust_prune(x[part])
            got = np.where(got >= 0, part[got], -1)
            second = own[part, 0] != c
            graph[part[~second], :DEGREE] = got[~second]
            graph[part[second], DEGREE:] = got[second]
    return graph, np.array(medoids)


def greedy(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where greedy walks from each query's nearest medoid end."""
    at = medoids[(q @ x[medoids].T).argmax(axis=1)]
    best = (q * x[at]).sum(axis=1)
    live = np.arange(len(q))
    while len(live):
        nb = graph[at[live]]
        sim = np.where(nb >= 0, np.einsum("qd,qkd->qk", q[live], x[nb]), -2)
        k = sim.argmax(axis=1)
        top = sim[np.arange(len(live)), k]
        up = top > best[live] + 1e-9
        live, k, top, nb = live[up], k[up], top[up], nb[up]
        at[live], best[live] = nb[np.arange(len(live)), k], top
    return at


def expand(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: list[np.ndarray], slack: float, room: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of the nodes reached from the starts over nodes with cosine >= slack; a step that would visit more than `room` pairs in all is not taken."""
    m = np.int64(len(x))
    seen, tag = np.zeros(len(q) * m, bool), np.zeros(len(q) * m, np.int32)

    def unseen(keys: np.ndarray) -> np.ndarray:
        keys = keys[~seen[keys]]
        no = np.arange(len(keys), dtype=np.int32)
        tag[keys] = no
        seen[keys] = True
        return keys[tag[keys] == no]  # each key once

    front = unseen(np.concatenate([np.arange(len(q)) * m + s for s in start]))
    out, visited = [(front[:0], front[:0], np.zeros(0, x.dtype))], 0
    while len(front) and (not visited or visited + len(front) <= room):
        visited += len(front)
        a, b = front // m, front % m
        sim = np.empty(len(a), x.dtype)
        for i in range(0, len(a), 1 << 17):
            sim[i : i + (1 << 17)] = np.einsum("ij,ij->i", q[a[i : i + (1 << 17)]], x[b[i : i + (1 << 17)]])
        fine = sim >= slack
        a, b = a[fine], b[fine]
        out.append((a, b, sim[fine]))
        front = unseen((a[:, None] * m + graph[b])[graph[b] >= 0])
    return tuple(np.concatenate(c) for c in zip(*out))


def graph_pairs(x32: np.ndarray, least: float, block: int = 256, slack: float = 0.08) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row, other) of pairs of unit vectors that the graph's search finds with cosine of about `least` or more, for each block of rows."""
    graph, medoids = flat_graph(x32)
    for i in range(0, len(x32), block):
        rows = np.arange(i, min(i + block, len(x32)))
        q = x32[rows]
        a, b, sim = expand(x32, graph, q, [greedy(x32, graph, medoids, q), rows], least - slack)
        near = sim >= least - 1e-4
        yield i, rows[a[near]], b[near]


def shard_pairs(x: np.ndarray, least: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j of unit vectors (double) with cosine >= least, in blocks: those that the graph finds, and what the check of all rows finds besides."""
    if len(x) < 2:
        return
    x32 = x.astype(np.float32)
    for i, a, b in graph_pairs(x32, least, block):
        lost = np.triu(x32[i : i + block] @ x32[i:].T >= least - 1e-4, 1)
        a, b = a[a < b], b[a < b]
        lost[a - i, b - i] = False
        yield from verified(x, x, a, b, least)
        a, b = np.nonzero(lost)
        yield from verified(x, x, a + i, b + i, least)


def verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those index pairs (of x, of y) whose cosine is >= least in double precision, in parts."""
    for k in range(0, len(a), 1 << 17):
        u, v = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
        fine = np.einsum("ij,ij->i", x[u], y[v]) >= least
        yield u[fine], v[fine]


def block_pairs(x: np.ndarray, y: np.ndarray | None, least: float, block: int = 256, wide: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (of x, of y) of unit vectors with cosine >= least, in blocks that stay in cache; without y, pairs i < j of x."""
    other = x if y is None else y
    x32, y32 = x.astype(np.float32), other.astype(np.float32)
    for i in range(0, len(x), block):
        for j in range(i if y is None else 0, len(other), wide):
            near = x32[i : i + block] @ y32[j : j + wide].T >= least - 1e-4
            if not near.any():
                continue
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            if y is None:
                a, b = a[a < b], b[a < b]
            yield from verified(x, other, a, b, least)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: What a row is in its shard: at home and searched by the graph; guest, compared with the homes; at home and compared
#: with guests only; at home and compared with all.
HOME, GUEST, CROSS, WHOLE = range(4)


def children(x: np.ndarray, pivots: np.ndarray, home: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, side) of where each unit vector goes: home to its nearest pivot, guest wherever a link may be at home."""
    sim = x @ pivots.T
    reach = np.sqrt(2 - 2 * least) * np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0)) + 1e-7
    may = np.ones(sim.shape, bool)
    for q in range(len(pivots)):
        may &= sim[:, q : q + 1] - sim <= reach[q]
    own = sim.argmax(axis=1)
    may &= ~home[:, None] | (np.arange(len(pivots)) < own[:, None])  # two homes meet in the earlier cell
    row, no = np.nonzero(may)
    at = np.flatnonzero(home)
    return np.concatenate([at, row]), np.concatenate([own[at], no]), np.repeat([HOME, GUEST], [len(at), len(row)])


def _split(rows: DataFrame, least: float, most: int, fan: int) -> DataFrame:
    """rows(rid, cell, side, w, x), all at home, with every cell of more than `most` rows split so that each pair that may link meets once.

    A cell's rows are dealt in parts of about `most`, and each part gets the cell's pivots once, before its rows.
    """
    done, n_level = None, 0
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("count"), F.count_if(F.col("side") == HOME).alias("homes"), F.max(F.size("x")).alias("dim"))
        large = store(sizes.where(F.col("count") > most).withColumn("salts", F.ceil(F.col("count") / most).cast("int")), "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        chance = F.abs(F.xxhash64("rid", F.lit(n_level)) % 1_000_000) < F.col("homes").__rtruediv__(1_000_000 * fan)
        pivots = rows.join(large, "cell").where(chance & (F.col("side") == HOME)).groupBy("cell", "salts").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("rid").alias("h"), F.col("x")))), 1, 2 * fan).alias("p"))
        pivots = store(pivots.select("cell", "salts", F.explode("p.x").alias("x")), "pivots")
        pivots = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).alias("side"), F.lit(0).cast("long").alias("rid"), "x")
        salted = rows.join(large, "cell").select("cell", F.pmod(F.xxhash64("rid", F.lit("salt")), F.col("salts")).cast("int").alias("salt"), "side", "rid", "x")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, own = None, []  # the cell and part at hand, and its pivots, which come before its rows
            for whole in batches:
                for i in range(0, whole.num_rows, 2000):
                    b = whole.slice(i, 2000)
                    cells, salt, side, rid = (b.column(c).to_numpy() for c in ("cell", "salt", "side", "rid"))
                    out = []
                    edges = np.flatnonzero((cells[1:] != cells[:-1]) | (salt[1:] != salt[:-1])) + 1
                    for at in np.split(np.arange(len(cells)), edges):
                        key = (int(cells[at[0]]), int(salt[at[0]]))
                        if key != held:
                            held, own = key, []
                        if (first := at[side[at] < 0]).size:
                            own.append(_vectors(b.column("x").take(pa.array(first))))
                        if (rest := at[side[at] >= 0]).size and own:
                            row, no, to = children(_vectors(b.column("x").take(pa.array(rest))), np.concatenate(own), side[rest] == HOME, least)
                            out.append((rest[row], no, to))
                    if out:
                        at, no, to = (np.concatenate(c) for c in zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(cells[at]), pa.array(rid[at]), pa.array(no, pa.int32()), pa.array(to, pa.int32())], ["cell", "rid", "no", "to"])

        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = salted.unionByName(pivots).repartition(n, "cell", "salt").sortWithinPartitions("cell", "salt", "side")
        to = store(dealt.mapInArrow(choose, "cell long, rid long, no int, to int"), "children")
        counts = to.groupBy("cell", "no").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
        pays = store(counts.join(large, "cell").where("2 * top <= count and total <= 2 * count").select("cell"), "pays")
        done = done.unionByName(_blocks(rows, large.join(pays, "cell", "left_anti"), most, n_level))
        cut = rows.drop("side").join(to.join(pays, "cell"), ["cell", "rid"])
        rows = store(cut.select("rid", F.xxhash64("cell", "no", F.lit(n_level)).alias("cell"), F.col("to").alias("side"), "w", "x"), "cells")
        n_level += 1


def _blocks(rows: DataFrame, cells: DataFrame, most: int, n_level: int) -> DataFrame:
    """The rows of `cells` as a cell for each pair of chunks that holds homes; chunks are bounded by rows and by numbers."""
    chunk = F.greatest(F.lit(2), F.least(F.lit(4 * most), F.floor(F.lit(1 << 22) / F.col("dim"))))
    parts = cells.select("cell", F.ceil(F.col("homes") / chunk).cast("int").alias("k"), F.ceil((F.col("count") - F.col("homes")) / chunk).cast("int").alias("m"))
    home, h = F.col("side") == HOME, F.xxhash64("rid", F.lit(-1))
    own = F.when(home, F.pmod(h, F.col("k"))).otherwise(F.col("k") + F.pmod(h, F.greatest("m", F.lit(1)))).cast("int")
    out = rows.join(store(parts.where("k > 0"), "parts"), "cell").withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(home, F.col("k") + F.col("m")).otherwise(F.col("k")) - 1)))
    side = F.when(F.col("own") == F.col("other"), WHOLE).when(F.col("own") < F.col("other"), CROSS).otherwise(GUEST)
    return out.select("rid", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"), F.lit(f"b{n_level}")).alias("cell"), side.cast("int").alias("side"), "w", "x")


def near_vectors(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", most: int = 6000, fan: int = 16) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row."""
    spark = table.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & (F.size(F.coalesce(v, F.array().cast("array<double>"))) > 0)
    fine = fine & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0)
    rows = table.select(F.col(id_col).alias("id"), F.when(F.coalesce(fine, F.lit(False)), F.col(vector)).alias("x"), F.col(label).alias("label"))
    rows = store(rows.withColumn("grp", F.when(F.col("x").isNotNull(), F.xxhash64("label", F.size("x")))).withColumn("hx", F.xxhash64("x")), "vectors")
    classes = rows.where("x is not null").groupBy("grp", "label", "x").agg(F.count("*").alias("w"), F.min("id").alias("first_id"))
    classes = store(classes.withColumn("rid", F.monotonically_increasing_id()).withColumn("hx", F.xxhash64("x")), "classes")
    homes = classes.select("rid", F.col("grp").alias("cell"), F.lit(HOME).alias("side"), "w", "x")
    cells = _split(homes, least, most, fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in whole_groups(batches, "cell", 4000):
            cell, x = t.column("cell").to_numpy(), t.column("x").combine_chunks()
            rid, w, side = (t.column(c).to_numpy() for c in ("rid", "w", "side"))
            edges = group_edges(cell)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                n = b - a
                at, guest = np.flatnonzero(side[a:b] != GUEST), np.flatnonzero(side[a:b] == GUEST)
                if not len(at):
                    continue
                links, parent, weight = np.zeros(n, np.int64), np.arange(n), w[a:b]
                v = _vectors(x.slice(a, n))
                how = side[a + at[0]]
                inside = shard_pairs(v[at], least) if how == HOME else block_pairs(v[at], None, least) if how == WHOLE else ()
                across = block_pairs(v[at], v[guest], least) if len(guest) else ()
                for pairs, other in ((inside, at), (across, guest)):
                    for i, j in pairs:
                        i, j = at[i], other[j]
                        links += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
                        parent = unite(parent, i, j)
                met = np.flatnonzero((links > 0) | (find_roots(parent) != np.arange(n)))
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][met]), pa.array(rid[a:b][parent[met]]), pa.array(links[met])], ["u", "v", "links"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = store(cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long, links long"), "links")
    links = found.groupBy(F.col("u").alias("rid")).agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v"))
    rooted = classes.join(roots, classes.rid == roots.node, "left").select("rid", "grp", "hx", "label", "x", "w", "first_id", F.coalesce("root", "rid").alias("root"))
    rooted = store(rooted, "rooted")  # stored sides, so that joins can be split at a giant component
    least_id = store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    of = rooted.join(least_id, "root").join(links, "rid", "left").select("grp", "hx", F.col("x").alias("cx"), F.col("label").alias("cl"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    of = store(of, "of")
    out = rows.join(of, (rows.grp == of.grp) & (rows.hx == of.hx) & (rows.x == of.cx) & (rows.label == of.cl), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
