"""What the operators share: stored tables, stable row ids, whole groups in Arrow batches, connected components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and the master is local (tests on one machine) is a local folder made; a cluster
    without the setting is an error, as its executors would not see each other's files.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="paywarden-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = "file://" + _own[app]
    return f"{base.rstrip('/')}/paywarden-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it is removed when the JVM ends."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _made.append(out)
    return out


def made() -> int:
    """How many paths new_path has given; see clear."""
    return len(_made)


def clear(spark: SparkSession, since: int, keep: tuple[str, ...] = (), upto: int | None = None) -> None:
    """Remove what was stored since made() said so (until it said `upto`), but for `keep`: for callers that have written a result and read no frame of that time again."""
    for out in _made[since:upto]:
        if out not in keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(out)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:upto] = [x for x in _made[since:upto] if x in keep]


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_id(df: DataFrame, name: str = "rid", most_files: int = 20_000) -> DataFrame:
    """Add a long that identifies each row: file number and row number in that file.

    It comes from the files alone, so each scan gives a row the same id however the scan is split. A frame that is
    not a plain scan of files is stored first. The broadcast side has a row per input file and is used up to
    `most_files`; tables of more files are stored with their row ids instead. `name` must be free in df.
    """
    try:
        df.select("_metadata.row_index")
        plain = len(df.inputFiles()) <= most_files
    except AnalysisException:
        plain = False
    if not plain:
        return store(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    spark = df.sparkSession
    file, row, no = (free_name(df, c) for c in ("file", "row", "no"))
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())  # a row per input file
    numbers = spark.createDataFrame([(f, i) for i, f in enumerate(files)], f"{file} string, {no} long")
    out = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return out.join(F.broadcast(numbers), file).withColumn(name, F.shiftleft(no, 40) + F.col(row)).drop(file, row, no)


def keep_rows(df: DataFrame, marks: DataFrame, rid: str, but: bool = False, most: int = 1 << 20) -> DataFrame:
    """Rows of df whose `rid` (see with_row_id) is among those of marks, or with `but` is not; wide rows are not dealt out for it.

    The broadcast side has a bit per row, 64 to a word. Above `most` words (64 million rows where all words are in use)
    it is a plain join.
    """
    word, bits = free_name(df, "word"), free_name(df, "bits")
    of = lambda c: F.shiftright(F.col(c), 6)
    bit = F.expr(f"shiftleft(1L, cast(`{rid}` & 63 as int))")
    words = store(marks.groupBy(of(rid).alias(word)).agg(F.bit_or(bit).alias(bits)), "words")
    if words.count() > most:
        return df.join(marks.select(rid).distinct(), rid, "left_anti" if but else "left_semi").select(*df.columns)
    here = df.join(F.broadcast(words), of(rid) == F.col(word), "left")
    found = F.coalesce(F.col(bits).bitwiseAND(bit), F.lit(0)) != 0
    return here.where(~found if but else found).select(*df.columns)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of a column pass `most`, so that what is made from a slice stays small."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) // most).astype(np.int64))) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after another, offsets of n + 1) of a string or binary array; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 20_000, weigh: Callable[[pa.RecordBatch], int] = lambda b: b.num_rows) -> Iterator[pa.Table]:
    """Tables of about `rows` (by weigh) that hold whole groups of the integer column `key`; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += weigh(b)
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        other = np.flatnonzero(k != k[-1])
        if other.size:
            cut = int(other[-1]) + 1
            yield t.slice(0, cut)
            t = t.slice(cut)
        held = t.to_batches()
        n = sum(map(weigh, held))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_edges(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def find_roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hook the classes of a[i] and b[i] together, smallest index as root; parent holds roots before and after."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = find_roots(parent)
    return parent


def stars(parent: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each name to the least of its class, so that classes found in several places mostly share their centre."""
    root, least = find_roots(parent), names.copy()
    np.minimum.at(least, root, names)
    centre = least[root]
    child = names != centre
    return names[child], centre[child]


def _stars(e: DataFrame) -> bool:
    """Whether edges (u, v) with u > v are disjoint stars: each u has one v and is no other's v."""
    ends = e.select(F.explode(F.array(*[F.struct(F.col(c).alias("x"), F.lit(up).alias("up")) for c, up in (("u", 1), ("v", 0))])).alias("end"))
    nodes = ends.select("end.*").groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not nodes.agg(F.count_if(F.expr("ups > 1 or (ups = 1 and least = 0)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v): rows (node, root) for each node that has a link, root the smallest node.

    Alternating large-star and small-star rounds; each is a min by key with map-side combining and an equi-join that
    adaptive execution may split when a star is very large. Each round ends in a stored table, after which the round's
    other tables are removed, and the rounds end as soon as the edges are disjoint stars.
    """
    e = store(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = store(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")  # stored, so a hot x can be split
        big = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        big = store(big, "edges")
        low = store(big.groupBy("u").agg(F.min("v").alias("m")), "least")
        before = (e, least, big, low)
        e = store(
            big.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        discard(*before)


_held: dict = {}


def per_worker(key: object, make: Callable[[], object]):
    """What make() gives, made once per Python worker and key, as workers run many tasks; few of them are held at a time."""
    if key not in _held:
        if len(_held) >= 4:
            _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Free what per_worker holds for operators before this one, and give freed memory back to the system.

    Workers outlive stages; without this a stage that needs much memory would find the tables of earlier ones there.
    """
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class WordTable:
    """Arrays of numbers that belong to words, made in bulk when a word is first met.

    make(words) returns (all numbers one after another, how many each has). Words of at most `longest` characters stay
    until there are `most` of them; what comes beyond lives until the next call, so memory is bounded for any number of
    distinct words of any length.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 200_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.index: dict[str, int] = {}
        self.flat: np.ndarray | None = None
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.kept = (0, 0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """A number for each word, good for `gather` until the next call."""
        n, used = self.kept
        out = list(map(self.index.get, words))
        if None in out:
            new = list(dict.fromkeys([w for w, v in zip(words, out) if v is None]))
            new.sort(key=lambda w: len(w) > self.longest)  # those that may stay come first
            flat, sizes = self.make(new)
            if self.flat is None:
                self.flat = np.zeros(1 << 14, flat.dtype)
            self.flat = _room(self.flat, used + len(flat))
            self.start, self.size = _room(self.start, n + len(new)), _room(self.size, n + len(new))
            self.flat[used : used + len(flat)] = flat
            self.size[n : n + len(new)] = sizes
            self.start[n : n + len(new)] = used + np.cumsum(sizes) - sizes
            at = dict(zip(new, range(n, n + len(new))))
            if len(self.index) < self.most:
                short = sum(len(w) <= self.longest for w in new)
                self.index.update(zip(new[:short], range(n, n + short)))
                self.kept = (n + short, used + int(sizes[:short].sum()))
            out = [at[w] if v is None else v for w, v in zip(words, out)]
        return np.array(out, np.int64)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of the words one after another, how many each has)."""
        sizes = self.size[numbers]
        if self.flat is None or not len(numbers):
            return np.zeros(0, np.int32), sizes
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    def rows(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """The words' numbers as rows, where each word has k of them."""
        if self.flat is None:
            return np.zeros((len(numbers), k))
        return self.flat[: len(self.flat) // k * k].reshape(-1, k)[numbers]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class ByteTable:
    """Byte strings by number, joined for whole arrays of numbers."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(values) or b"\0", np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all, where each number's bytes begin and the length at the end)."""
        sizes = self.size[numbers]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return self.raw[np.repeat(self.start[numbers] - edges[:-1], sizes) + np.arange(edges[-1])], edges
