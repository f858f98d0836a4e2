"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. For each language, piece probabilities are fitted by expectation
maximisation: a first pass with equal probabilities, then passes with expected piece counts over all segmentations of
the training words. A word's probability in a language is the sum over all its segmentations of the product of their
piece probabilities, by the forward algorithm; a text's score is the product over its words, and the posterior of the
best language, with equal priors, is the score returned.

The forward pass runs over all new words of a batch at once: substrings are looked up by rolling hash in one table of
the vocabulary, and a matrix (words x languages) of prefix sums moves along the words. Words met before come from a
bounded table.

Training reads a bounded sample: about `per_language` labelled rows of each language, chosen by a hash of the row's
key, or all rows where there are fewer, and of at most `languages` languages. The model has (vocabulary x languages)
numbers, whatever the input's size.

Defined cases: text that is null or has no letter is `und` with score 0; without any training rows all texts are
`und`; ties go to the language first in order; words above 40 characters are cut every 40, and each part is summed
over its segmentations; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, per_worker, slices, store
from .tables import KeyTable

SPACE, PART, UNKNOWN, SMOOTH = "▁", 40, 1e-6, 0.1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece model file that stand for text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


def parts_of(word: str) -> list[str]:
    """A word with its leading space mark, cut in parts of PART characters."""
    w = SPACE + word
    return [w] if len(w) <= PART else [w[i : i + PART] for i in range(0, len(w), PART)]


class Forward:
    """Sums over segmentations for many words at once, for each row of a matrix of piece probabilities."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        points = [np.fromiter(map(ord, p), np.uint64, len(p)) for p in pieces]
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(points):
            h = np.uint64(0)
            for c in p.tolist():
                h = np.uint64((int(h) * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF)
            keys[i] = h
        self.table = KeyTable(keys, np.arange(len(pieces), dtype=np.int32))

    def matches(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """For words of one length: (rows, end, length, piece number) of each place where pieces may end."""
        m = len(words[0])
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, m).astype(np.uint64) + np.uint64(1)
        for end in range(1, m + 1):
            h = np.zeros(len(words), np.uint64)
            power = np.uint64(1)
            for k in range(1, min(self.longest, end) + 1):
                h = h + c[:, end - k] * power
                power = np.uint64((int(power) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF)
                got = self.table.get(h)
                rows = np.flatnonzero(got >= 0)
                if len(rows):
                    yield rows, end, k, got[rows]

    def log_sums(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word (at most PART characters) in each language; prob is pieces x languages."""
        out = np.zeros((len(words), prob.shape[1]))
        for m, at in self._blocks(words, prob.shape[1]):
            out[at] = np.log(self._alpha([words[i] for i in at], m, prob)[0][:, m])
        return out

    @staticmethod
    def _blocks(words: list[str], languages: int, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places) of words of one length, few enough at a time for `most` numbers in their prefix sums."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for m in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == m)
            step = max(1, most // ((m + 1) * max(1, languages)))
            for i in range(0, len(at), step):
                yield m, at[i : i + step]

    def _alpha(self, words: list[str], m: int, prob: np.ndarray) -> tuple[np.ndarray, list]:
        alpha = np.zeros((len(words), m + 1, prob.shape[1]))
        alpha[:, 0] = 1
        seen, met = [], 0
        for rows, end, k, piece in self.matches(words):
            while met < end:  # characters outside the vocabulary stay possible
                met += 1
                alpha[:, met] = alpha[:, met - 1] * UNKNOWN
            alpha[rows, end] += alpha[rows, end - k] * prob[piece]
            seen.append((rows, end, k, piece))
        while met < m:
            met += 1
            alpha[:, met] = alpha[:, met - 1] * UNKNOWN
        return alpha, seen

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x languages) where word i occurs counts[i, language] times."""
        out = np.zeros_like(prob)
        for m, at in self._blocks(words, prob.shape[1]):
            alpha, seen = self._alpha([words[i] for i in at], m, prob)
            beta = np.zeros_like(alpha)
            beta[:, m] = 1
            weight = counts[at] / alpha[:, m]
            j = m
            for rows, end, k, piece in reversed(seen):
                while j > end:
                    beta[:, j - 1] += beta[:, j] * UNKNOWN
                    j -= 1
                flow = beta[rows, end] * prob[piece]
                beta[rows, end - k] += flow
                np.add.at(out, piece, alpha[rows, end - k] * flow * weight[rows])
        return out


def fit(docs: DataFrame, path: str, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, rounds: int = 2, languages: int = 200) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-free probabilities pieces x languages) from the rows where `train` holds.

    At most `languages` values of `lang` are learned, those of most rows (then the first in order): the bound of the model.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(key).alias("x"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}  # a row per language
    langs = sorted(sizes)
    pieces = vocabulary(path)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    chosen = F.lit(False)
    for g in langs:
        share = min(1.0, per_language / sizes[g])
        chosen = chosen | ((F.col("lang") == g) & (F.shiftrightunsigned("x", 11) <= F.lit(int(2**53 * share))))
    words = rows.where(chosen).select("lang", F.explode(F.split(F.col("t"), r"\s+")).alias("w")).where("w <> ''")
    number = F.create_map(*[x for i, g in enumerate(langs) for x in (F.lit(g), F.lit(i))])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = store(words.groupBy(number[F.col("lang")].alias("g"), "w").count().repartition(n), "words")
    spark = docs.sparkSession
    prob = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(prob)  # vocabulary x languages

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            forward, total = per_worker(("forward", path), lambda: Forward(pieces)), np.zeros_like(held.value)
            for b in batches:
                g, c = b.column("g").to_numpy(), b.column("count").to_numpy()
                parts, row, seen = [], [], {}
                for i, w in enumerate(b.column("w").to_pylist()):
                    for p in parts_of(w):
                        parts.append(seen.setdefault(p, len(seen)))
                        row.append(i)
                if not seen:
                    continue
                counts = np.zeros((len(seen), total.shape[1]))
                np.add.at(counts, (np.array(parts), g[row]), c[row])
                total += forward.expected(list(seen), counts, held.value)
            piece, lang_no = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang_no), pa.array(total[piece, lang_no])], ["piece", "g", "n"])

        got = words.mapInArrow(expect, "piece long, g long, n double").groupBy("piece", "g").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages at most
        counts = np.full_like(prob, SMOOTH)
        np.add.at(counts, (got.piece.to_numpy(np.int64), got.g.to_numpy(np.int64)), got.n.to_numpy(float))
        prob = counts / counts.sum(axis=0)
        held.unpersist()
    return langs, prob


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of each row."""
    langs, prob = model
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names) + "lang_pred string, score double"
    held, fitted = docs.sparkSession.sparkContext.broadcast(prob), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        forward, k = per_worker(("forward", path), lambda: Forward(vocabulary(path))), p.shape[1]

        def make(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [parts_of(w) for w in words]
            flat = [x for ps in parts for x in ps]
            sums = forward.log_sums(flat, p) if flat else np.zeros((0, k))
            edges = np.cumsum([0, *map(len, parts)])
            return np.add.reduceat(sums, edges[:-1]).ravel(), np.full(len(words), k)

        table = per_worker(("words", fitted), lambda: WordTable(make))
        names_of = np.array([*langs, "und"], object)
        for whole in batches:
            for b in slices(whole, "t", 1 << 20):
                texts = b.column("t").to_pylist()
                best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
                if langs:
                    lists = [x.split() if x is not None and any(map(str.isalpha, x)) else [] for x in texts]
                    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                    logs = table.rows(table.numbers([w for x in lists for w in x]), k)
                    full = np.flatnonzero(sizes)
                    if len(full):
                        sums = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
                        best[full] = sums.argmax(axis=1)
                        score[full] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(names_of[best], pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score")


def fold_of(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 4; null keys have none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4
