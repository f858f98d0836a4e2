"""Removal of long repeated byte strings with suffix arrays by induced sorting.

A byte goes when a string of `width` (200) bytes that covers it also starts anywhere else, in the same or another
document. The work is done in three steps.

1. Sharding. Each window of `width` bytes is owned by its anchor, the leftmost least 16-byte gram in it by hash.
   Equal windows have equal anchors, so windows need comparing only within an anchor's shard. The windows that one
   anchor owns in a row form a region. Anchors met once are done; a region whose bytes occur at several places is a
   repeated row, folded by a map-side aggregate and marked as a whole.
2. Suffix arrays. The distinct regions of an anchor, with those of many other anchors, are laid one after another
   (byte 255, which UTF-8 never has, between them) and sorted: suffixes are classed, the leftmost-smaller substrings
   sorted by induction and named, the names' suffixes ranked (recursion by doubling, because Python-level buckets
   don't pay for a large alphabet), and the array induced bucket by bucket in linear time, each bucket in bulk.
   Permuted common prefixes (irreducible ones compared, the rest one less than the one before) tell which windows
   occur again.
3. Cutting. The marked windows of a document, merged to runs block by block, come together by row id and cut its bytes.

Hot anchors (above `most` distinct regions) are split exactly: windows are told apart by where the anchor lies in
them, in halves, each keyed with the bytes that all windows of the half share. Halves go on to halves until a group
is small; a half of one offset is a whole window, where equal key means equal window.

Defined cases: null text counts as empty; texts under `width` bytes lose nothing; a text that repeats as a whole
loses every byte in all copies; repeated rows (even with the same id) are separate documents; empty table, empty
result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, group_edges, let_go, slices, store, whole_groups, with_row_id

GRAM = 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _words(buf: np.ndarray, pad: int = 8) -> np.ndarray:
    """The eight bytes from each position as a number, zeros past the end."""
    held = np.zeros(len(buf) + pad, np.uint8)
    held[: len(buf)] = buf
    return np.ndarray((len(buf),), np.dtype("<u8"), held, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M3
    x ^= x >> np.uint64(29)
    return x


def regions(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, first window, last window, anchor), positions in buf, of each region of the texts in buf."""
    sizes = np.diff(offsets)
    n = len(buf)
    if n < width or not (sizes >= width).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    w = _words(buf)
    grams = _mix(w[: n - 8] * _M1 + (w[8:] ^ (w[8:] >> np.uint64(31))) * _M2)
    span = width - GRAM + 1
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    m = -(-len(key) // span) * span
    key = np.concatenate([key, np.full(m - len(key) + span, np.iinfo(np.uint64).max)]).reshape(-1, span)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    owner = (np.minimum(right[:starts], left[span - 1 : span - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    long = sizes >= width
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:starts], dtype=np.int8))
    own = owner[at]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(at)]]) - 1
    lo, hi, p = at[first], at[last], own[first]
    doc = np.searchsorted(offsets, lo, side="right") - 1
    return doc, grams[p].view(np.int64), lo, hi, p


def parts(buf: np.ndarray, offsets: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text number, place in its text) of parts whose windows are those of the texts, each in one part.

    A text over `most` bytes is cut at each `most`-th window, so parts overlap by width - 1 bytes; the others come as one.
    """
    sizes = np.diff(offsets)
    for i in np.flatnonzero(sizes > most).tolist():
        for at in range(0, max(1, int(sizes[i]) - width + 1), most):
            part = buf[offsets[i] + at : min(offsets[i] + at + most + width - 1, offsets[i + 1])]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at])
    short = np.flatnonzero(sizes <= most)
    if len(short) == len(sizes):
        yield buf, offsets, short, np.zeros(len(short), np.int64)
    else:
        kept = [buf[offsets[i] : offsets[i + 1]] for i in short.tolist()]
        yield np.concatenate([buf[:0], *kept]), np.concatenate([[0], np.cumsum(sizes[short])]), short, np.zeros(len(short), np.int64)


def occurrences(rows: DataFrame, text: str, width: int, most: int = 1 << 20) -> DataFrame:
    """(rid, h anchor hash, r hash of the region's bytes, lo first window, len windows less one, po anchor less lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        names = ["rid", "h", "r", "lo", "len", "po"]
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for b in slices(whole, "t", most):
                rids = b.column("rid").to_numpy()
                for buf, offsets, number, place in parts(*flat_bytes(b.column("t")), width, most):
                    doc, h, lo, hi, p = regions(buf, offsets, width)
                    view = memoryview(buf)
                    r = np.array([digest(view[i : j + width]) for i, j in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64)
                    at = lo - offsets[doc] + place[doc]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rids[number[doc]]), pa.array(h), pa.array(r), pa.array(at.astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array((p - lo).astype(np.int32))],
                        names,
                    )

    return rows.select("rid", F.col(text).alias("t")).mapInArrow(run, "rid long, h long, r long, lo int, len int, po int")


# ---------------------------------------------------------------- suffix array


def _induce(t: np.ndarray, sa: np.ndarray, smaller: np.ndarray, heads: np.ndarray, tails: np.ndarray, marked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Fill sa from the leftmost-smaller suffixes in `marked` (positions in order, their bucket edges), bucket by bucket.

    Entries of a bucket induce their predecessors in bulk; predecessors in the same bucket are taken up in rounds.
    """
    order, edges = marked
    k = len(heads)
    fill = heads.copy()

    def place(of: np.ndarray, want_larger: bool) -> np.ndarray:
        of = of[of > 0] - 1
        return of[smaller[of] != want_larger]

    sa[:] = -1
    for c in range(k):
        done = heads[c]
        while True:
            got = sa[done : fill[c]]
            done = fill[c]
            if not len(got):
                break
            _put(t, sa, fill, place(got, True), False)
        own = order[edges[c] : edges[c + 1]]
        if len(own):
            _put(t, sa, fill, place(own, True), False)
    ends = fill.copy()  # of the larger-type part of each bucket
    fill = tails.copy()
    for c in range(k - 1, -1, -1):
        done = tails[c]
        while True:
            got = sa[fill[c] : done][::-1]
            done = fill[c]
            if not len(got):
                break
            _put(t, sa, fill, place(got, False), True)
        got = sa[heads[c] : ends[c]][::-1]
        if len(got):
            _put(t, sa, fill, place(got, False), True)
    return sa


def _put(t: np.ndarray, sa: np.ndarray, fill: np.ndarray, what: np.ndarray, down: bool) -> None:
    if not len(what):
        return
    c = t[what]
    by = np.argsort(c, kind="stable")
    c, what = c[by], what[by]
    at = group_edges(c)
    sizes = np.diff(at)
    each = c[at[:-1]]
    rank = np.arange(len(c)) - np.repeat(at[:-1], sizes)
    if down:
        sa[np.repeat(fill[each], sizes) - 1 - rank] = what
        fill[each] -= sizes
    else:
        sa[np.repeat(fill[each], sizes) + rank] = what
        fill[each] += sizes


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names: doubling, only among suffixes that are still tied."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    at = group_edges(names[order])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(at[:-1], np.diff(at))
    tied = order[np.repeat(np.diff(at) > 1, np.diff(at))]
    step = 1
    while len(tied):
        second = rank[np.minimum(tied + step, n)]
        key = rank[tied] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        outer, inner = group_edges(group), group_edges(key)
        start = np.repeat(outer[:-1], np.diff(outer))
        sizes = np.diff(inner)
        rank[tied] = group + np.repeat(inner[:-1], sizes) - start
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    return rank[:n]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes by induced sorting; positions are 32-bit numbers."""
    n = len(data) + 1
    if n == 1:
        return np.zeros(0, np.int32)
    if n >= 1 << 31:
        raise ValueError("2 GiB or more in one suffix array")
    t = np.zeros(n, np.int16)
    t[:-1] = data
    t[:-1] += 1
    k = 257
    # a suffix is smaller than the next if its run of equal bytes is followed by a larger one; the end is smallest
    change = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.repeat(t[change] < t[change + 1], np.diff(change, prepend=-1))
    smaller[-1] = True
    del change
    left = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    heads = tails - counts

    def deal(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return order, np.concatenate([[0], np.cumsum(np.bincount(t[order], minlength=k))])

    sa = np.empty(n, np.int32)
    _induce(t, sa, smaller, heads, tails, deal(left[np.argsort(t[left], kind="stable")]))
    at_left = np.zeros(n, bool)
    at_left[left] = True
    order = sa[at_left[np.maximum(sa, 0)] & (sa >= 0)]
    del at_left
    if len(order) != len(left):  # the end itself is placed by no other suffix
        order = np.concatenate([left[-1:], order[order != n - 1]])
    # name equal substrings
    size = np.ones(n, np.int32)
    size[left[:-1]] = np.diff(left) + 1
    words = _words(t.view(np.uint8))[::2]  # four symbols of two bytes
    x, y = order[:-1], order[1:]
    same = size[x] == size[y]
    act = np.flatnonzero(same)
    off = 0
    while len(act):
        rest = size[x[act]] - off
        mask = np.where(rest >= 4, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.maximum(np.minimum(rest, 3), 0) * 16).astype(np.uint64)) - np.uint64(1))
        diff = (words[np.minimum(x[act] + off, n - 1)] ^ words[np.minimum(y[act] + off, n - 1)]) & mask
        same[act[diff != 0]] = False
        off += 4
        act = act[(diff == 0) & (rest > 4)]
    del size, words, x, y, act
    names = np.empty(n, np.int32)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    name = names[left]
    del names
    if len(order) > 1 and same.any():
        rank = _rank_names(name)
        order = np.empty_like(left)
        order[rank] = left
    _induce(t, sa, smaller, heads, tails, deal(order))
    sa[0] = n - 1
    return sa[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, anew: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: at each position, bytes (up to `most`) shared with the suffix before it in order.

    Irreducible positions (and those of `anew`) are compared eight bytes at a time; others have one less than the
    position before them.
    """
    n = len(data)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    irreducible = phi <= 0
    irreducible[1:] |= data[np.maximum(phi[1:] - 1, 0)] != data[:-1]
    irreducible[:1] = True
    irreducible[anew] = True
    length = np.zeros(n, np.int32)
    words = _words(data, 8)
    act = np.flatnonzero(irreducible & (phi >= 0)).astype(np.int32)
    off = 0
    while len(act) and off < most:
        a, b = act + off, phi[act] + off
        room = n - np.maximum(a, b)
        inside = room > 0
        length[act[~inside]] = off + room[~inside]
        act, a, b, room = act[inside], a[inside], b[inside], room[inside]
        diff = words[a] ^ words[b]
        low = np.where(diff == 0, 64, np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)))
        same = np.minimum(low >> 3, room)
        length[act] = off + same
        act = act[same == 8]
        off += 8
    del phi, words
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(irreducible, at, np.int32(0)))
    return np.maximum(length[last] - (at - last), 0)


def repeated_windows(data: np.ndarray, starts: np.ndarray, width: int, longest: int) -> np.ndarray:
    """True where the `width` bytes from a position occur at another position too; separators never match whole windows."""
    sa = suffix_array(data)
    before = common_prefixes(data, sa, longest + 2 * width, starts)  # both 32-bit
    out = before >= width
    follow = before[sa[1:]] >= width
    out[sa[:-1][follow]] = True
    return out


# ---------------------------------------------------------------- over documents


def _halves(hot: DataFrame, width: int) -> DataFrame:
    """Each piece cut in two by where the anchor lies in a window; keyed with the bytes all windows of a half share."""
    mid = F.floor((F.col("oa") + F.col("ob")) / 2).cast("int")
    half = hot.withColumn(
        "half", F.explode(F.array(F.struct(F.col("oa").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("ob").alias("b"))))
    )
    low, high = F.greatest("half.a", F.col("po") - F.col("len")), F.least("half.b", "po")
    half = half.withColumn("ol", low).withColumn("oh", high).where("ol <= oh and half.a <= half.b")
    skip = F.col("po") - F.col("oh")
    body = F.substring("content", skip + 1, F.col("oh") - F.col("ol") + width)
    shared = F.substring("content", F.col("po") - F.col("half.a") + 1, F.lit(width) - (F.col("half.b") - F.col("half.a")))
    return half.select(
        F.xxhash64("key", "half.a", shared).alias("key"),
        F.xxhash64(body, F.sha1(body)).alias("r"),
        "c", "rid", (F.col("lo") + skip).alias("lo"), (F.col("oh") - F.col("ol")).alias("len"), F.col("oh").alias("po"),
        body.alias("content"), F.col("half.a").alias("oa"), F.col("half.b").alias("ob"),
    )


def _sorted_marks(pieces: DataFrame, width: int, weight: int = 1 << 19) -> DataFrame:
    """Marks (rid, lo, hi) of the windows of pieces met once (c = 1) that occur again in their group's suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        weigh = lambda b: int(pa.compute.sum(pa.compute.binary_length(b.column("content"))).as_py() or 0)
        for t in whole_groups(batches, "key", weight, weigh):
            body, off = flat_bytes(pa.concat_arrays(t.column("content").chunks))
            n, sizes = t.num_rows, np.diff(off)
            starts = off[:-1] + np.arange(n)
            data = np.insert(body, off[1:], np.uint8(255))
            again = repeated_windows(data, starts, width, int(sizes.max()))
            windows = t.column("len").to_numpy().astype(np.int64) + 1
            once = t.column("c").to_numpy() == 1
            piece = np.repeat(np.flatnonzero(once), windows[once])
            k = np.arange(len(piece)) - np.repeat(np.cumsum(windows[once]) - windows[once], windows[once])
            hit = again[starts[piece] + k]
            piece, k = piece[hit], k[hit]
            cut = np.flatnonzero((piece[1:] != piece[:-1]) | (k[1:] != k[:-1] + 1)) + 1
            first = np.concatenate([[0], cut])[: len(piece)]
            last = (np.concatenate([cut, [len(piece)]]) - 1)[: len(first)]
            lo = t.column("lo").to_numpy()[piece[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.column("rid").to_numpy()[piece[first]]), pa.array((lo + k[first]).astype(np.int32)), pa.array((lo + k[last]).astype(np.int32))],
                ["rid", "lo", "hi"],
            )

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.select("key", "rid", "lo", "len", "c", "content").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "rid long, lo int, hi int")


def _repeated(rows: DataFrame, counts: DataFrame, on: list[str], n: str) -> DataFrame:
    """Rows whose key `on` has a count over one in `counts`, which has each key once.

    Keys with over a thousandth of all that is counted are fewer than a thousand, so they are broadcast and their
    rows stay out of the shuffle; the others meet by an equi-join in which no key has more than that thousandth.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * 1000 > total
    several = counts.where(F.col(n) > 1)
    large, rest = F.broadcast(several.where(hot).select(*on)), several.where(~hot).select(*on)
    return rows.join(large, on, "left_semi").unionByName(rows.join(large, on, "left_anti").join(rest, on, "left_semi"))


def repeated_marks(rows: DataFrame, text: str = "text", width: int = 200, most: int = 2000) -> DataFrame:
    """(rid, lo, hi): windows lo..hi of row rid start a string of `width` bytes that starts elsewhere too."""
    met = store(occurrences(rows, text, width), "regions")
    shards = (
        met.groupBy("h").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1")).where("n > 1")
        .select("h", (F.col("r0") == F.col("r1")).alias("alike"))
    )
    shared = store(met.join(store(shards, "shards"), "h"), "shared")  # a stored side lets adaptive execution split hot anchors
    whole = F.col("lo") + F.col("len")
    marks = [shared.where("alike").select("rid", "lo", whole.alias("hi"))]
    mixed = shared.where("not alike")
    distinct = mixed.groupBy("h", "r").agg(F.count("*").alias("c"), F.min(F.struct("rid", "lo", "len", "po")).alias("at"))
    distinct = store(distinct.select(F.col("h").alias("key"), "r", "c", "at.*"), "distinct")
    marks.append(_repeated(mixed, distinct.select(F.col("key").alias("h"), "r", "c"), ["h", "r"], "c").select("rid", "lo", whole.alias("hi")))
    bodies = rows.select("rid", F.col(text).cast("binary").alias("body"))
    pieces = distinct.join(bodies, "rid").select("key", "r", "c", "rid", "lo", "len", "po", F.substring("body", F.col("lo") + 1, F.col("len") + width).alias("content"))
    pieces = store(pieces.withColumns({"oa": F.lit(0), "ob": F.lit(width - GRAM)}), "pieces")
    while True:
        hot = store(pieces.groupBy("key").count().where(F.col("count") > most).select("key"), "hot")  # stored, so that joins with it move no key's rows to one task
        if hot.isEmpty():
            marks.append(_sorted_marks(pieces, width))
            break
        marks.append(_sorted_marks(pieces.join(hot, "key", "left_anti"), width))
        hot = store(pieces.join(hot, "key", "left_semi"), "hot")
        cut = store(_halves(hot, width), "halves")
        alike = cut.groupBy("key", "r").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.min(F.struct("rid", "lo", "len", "po", "content", "oa", "ob")).alias("at"))
        alike = store(alike.select("key", "r", "c", "n", "at.*"), "alike")
        marks.append(_repeated(cut.where("c = 1"), alike, ["key", "r"], "n").select("rid", "lo", whole.alias("hi")))
        pieces = alike.where("oa < ob").drop("n")
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def _runs(marks: DataFrame, width: int, block: int = 14) -> DataFrame:
    """(rid, runs): marks that start in the same 2**block bytes of a row, those merged whose strings overlap or touch.

    So a row's runs are at most one for each `width` bytes of it, and two for each block, however many marks it has.
    """
    some = marks.groupBy("rid", F.shiftright("lo", block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("m"))
    run = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    first = F.get("m", F.lit(0))
    start = F.struct(F.slice("m", 1, 0).alias("out"), run(first["lo"], first["hi"]).alias("at"))

    def step(acc, x):
        joined = F.struct(acc["out"].alias("out"), run(acc["at"]["lo"], F.greatest(acc["at"]["hi"], x["hi"])).alias("at"))
        return F.when(x["lo"] <= acc["at"]["hi"] + width, joined).otherwise(F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), x.alias("at")))

    return some.select("rid", F.aggregate("m", start, step, lambda acc: F.concat(acc["out"], F.array(acc["at"]))).alias("runs"))


def cut_repeats(docs: DataFrame, text: str = "text", width: int = 200, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row, n_bytes, n_removed, n_spans, `kept` (binary): what is left of the text, and `kept_text`: its whole characters."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = with_row_id(docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t")))
    marks = repeated_marks(rows.select("rid", "t"), "t", width)
    by_row = _runs(marks, width).groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("marks"))
    src = rows.join(by_row, "rid", "left").select(*names, "t", F.col("marks.lo").alias("lo"), F.col("marks.hi").alias("hi"))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t"):
                buf, off = flat_bytes(b.column("t"))
                out: list[tuple[int, int, int, bytes]] = []
                los, his = b.column("lo"), b.column("hi")
                for i in range(b.num_rows):
                    body = buf[off[i] : off[i + 1]]
                    lo = los[i].values
                    if lo is None or not len(lo):
                        out.append((len(body), 0, 0, body.tobytes()))
                        continue
                    cover = np.zeros(len(body) + 1, np.int32)
                    np.add.at(cover, lo.to_numpy(), 1)
                    np.add.at(cover, his[i].values.to_numpy() + width, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    out.append((len(body), int(gone.sum()), spans, body[~gone].tobytes()))
                n_bytes, removed, spans, left = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in names], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())],
                    [*names, "n_bytes", "n_removed", "n_spans", "kept", "kept_text"],
                )

    out = src.mapInArrow(run, f"{schema}n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", "n_removed", "n_spans", "kept", "kept_text")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
