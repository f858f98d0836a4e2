"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Words (a run of spaces and what follows it) never merge with each other, as no piece holds a space after another
character. The symbols of all words of a call are one flat array. A round finds each word's least pair rank
(segmented minimum), merges its leftmost pairs of that rank all at once, and compacts; words without a mergeable pair
leave. A pair whose piece may at once take part in a pair of no higher rank is merged one at a time per word, so the
order is the one-by-one order of the library. Words met before come from a bounded table.

Words above `heap_from` symbols (a run of a hundred thousand characters without a space) go through a heap with the
same rule, since a round a merge would be quadratic there.

Defined cases: null text is empty and has no ids; a text of spaces only is encoded like any other; characters outside
the vocabulary become byte pieces; U+2581 counts as a space, as in the library; very long texts are taken in whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteTable, WordTable, group_edges, per_worker, slices
from .tables import KeyTable

SPACE = "▁"
_WORDS = re.compile(" +[^ ]*")


class PieceModel:
    """Pieces, scores and merges of a SentencePiece BPE model file."""

    def __init__(self, path: str, heap_from: int = 3000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.heap_from = heap_from
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.normal = set(normal)
        self.bodies = [bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(SPACE, " ").encode() if i in self.normal else b"" for i in range(n)]
        ids = {self.pieces[i]: i for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece with a space after another character: words don't split")
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        rank = np.full(n, 1 << 30, np.int64)
        for i in normal:
            rank[i] = ranks[sp.get_score(i)]
        self.rank = rank
        left, right, made = [], [], []
        unsafe = np.zeros(n, bool)
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    for part in (a, b):
                        if rank[i] <= rank[part]:
                            unsafe[part] = True
        self.n = n
        self.unsafe = unsafe
        self.pair_id = dict(zip(zip(left, right), made))
        self.pairs = KeyTable(np.array(left, np.uint64) * np.uint64(n) + np.array(right, np.uint64), np.array(made, np.int32))
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int32)
        fine = np.flatnonzero((a >= 0) & (b >= 0))
        out[fine] = self.pairs.get(a[fine].astype(np.uint64) * np.uint64(self.n) + b[fine].astype(np.uint64))
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each word has); words are as in the text, after their first space."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        full = [SPACE + w.replace(" ", SPACE) for w in words]
        sizes = np.fromiter(map(len, full), np.int64, len(full))
        points = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char_id[points].astype(np.int64)
        unknown = sym < 0
        sym[unknown] = -1 - points[unknown]
        word = np.repeat(np.arange(len(full)), sizes)
        done_sym, done_word = [], []
        long = sizes > self.heap_from
        if long.any():
            edges = np.concatenate([[0], np.cumsum(sizes)])
            for w in np.flatnonzero(long):
                got = self._heap(sym[edges[w] : edges[w + 1]])
                done_sym.append(got)
                done_word.append(np.full(len(got), w))
            short = ~long[word]
            sym, word = sym[short], word[short]
        inf = 1 << 30
        nxt = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            nxt[:-1] = np.where(word[1:] == word[:-1], self._merged(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(nxt >= 0, self.rank[nxt], inf)
            at = group_edges(word)
            least = np.minimum.reduceat(rank, at[:-1])
            sizes_now = np.diff(at)
            live = np.repeat(least < inf, sizes_now)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, nxt, rank = sym[live], word[live], nxt[live], rank[live]
                if not len(sym):
                    break
                at = group_edges(word)
                least = least[least < inf]
                sizes_now = np.diff(at)
            cand = np.flatnonzero(rank == np.repeat(least, sizes_now))
            fresh = np.ones(len(cand), bool)
            fresh[1:] = word[cand[1:]] != word[cand[:-1]]
            run = np.ones(len(cand), bool)
            run[1:] = (cand[1:] != cand[:-1] + 1) | fresh[1:]
            start = np.maximum.accumulate(np.where(run, np.arange(len(cand)), 0))
            take = (np.arange(len(cand)) - start) % 2 == 0
            risky = self.unsafe[nxt[cand]]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(cand)), 0))
            lone = np.logical_or.reduceat(risky, np.flatnonzero(fresh))
            take &= ~np.repeat(lone, np.diff(np.append(np.flatnonzero(fresh), len(cand)))) | (np.arange(len(cand)) == first)
            into = cand[take]
            sym[into] = nxt[into]
            keep = np.ones(len(sym), bool)
            keep[into + 1] = False
            new_at = np.cumsum(keep) - 1
            sym, word, nxt = sym[keep], word[keep], nxt[keep]
            changed = np.zeros(len(sym) + 1, bool)
            changed[new_at[into]] = True
            changed[new_at[into] - 1] = True  # the place before the first falls on the spare one at the end
            again = np.flatnonzero(changed[:-1])
            after = np.minimum(again + 1, len(sym) - 1)
            ok = (after > again) & (word[after] == word[again])
            nxt[again] = -1
            nxt[again[ok]] = self._merged(sym[again[ok]], sym[after[ok]])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        sym, word = sym[by], word[by]
        odd = np.flatnonzero(sym < 0)
        if len(odd):  # bytes of characters that the vocabulary lacks
            parts = [[self.byte_id[x] for x in chr(int(-1 - sym[i])).encode("utf-8", "surrogatepass")] for i in odd]
            reps = np.ones(len(sym), np.int64)
            reps[odd] = [len(p) for p in parts]
            at = np.cumsum(reps) - reps
            out = np.repeat(sym, reps)
            for i, p in zip(odd, parts):
                out[at[i] : at[i] + len(p)] = p
            sym, word = out, np.repeat(word, reps)
        return sym, np.bincount(word, minlength=len(full))

    def _heap(self, sym: np.ndarray) -> np.ndarray:
        s = sym.tolist()
        n = len(s)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if 0 <= i and j < n and (m := self.pair_id.get((s[i], s[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, s[i], s[j], m))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = m, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([x for x, y in zip(s, alive) if y], np.int64)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: pieces joined, runs of byte pieces read as UTF-8, the first space taken off."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.normal:
                out.append(self.pieces[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


def words_of(text: str) -> list[str]:
    """The words of a text, each without its first space; an empty text has none."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _WORDS.findall(" " + text)]
    return text.split(" ")


def _tables(path: str) -> tuple[WordTable, ByteTable, ByteTable]:
    """Ids by word; decimal digits and text by id."""
    model = PieceModel(path)
    return WordTable(model.encode_words), ByteTable([b"%d," % i for i in range(model.n)]), ByteTable(model.bodies)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns `keep`, n_tokens, ids (array, if with_ids), ids_sha256 of the comma-joined ids, and decoded text with its SHA-256."""
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names) + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digits, bodies = per_worker(("pieces", path), lambda: _tables(path))
        for whole in batches:
            for b in slices(whole, "t", 1 << 20):
                lists = [words_of(x) if x is not None else [] for x in b.column("t").to_pylist()]
                ids, sizes = table.gather(table.numbers([w for x in lists for w in x]))
                word_edges = np.concatenate([[0], np.cumsum(sizes)])
                edges = word_edges[np.concatenate([[0], np.cumsum([len(x) for x in lists])])]
                said, said_at = digits.join(ids)
                body, body_at = bodies.join(ids)
                said, body = memoryview(said), memoryview(body)
                id_hash, text_hash, texts = [], [], []
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    id_hash.append(hashlib.sha256(said[said_at[a] : max(said_at[z] - 1, said_at[a])]).hexdigest())
                    own = body[body_at[a] : body_at[z]]
                    if len(own) and own[0] == 32:
                        own = own[1:]
                    text_hash.append(hashlib.sha256(own).hexdigest())
                    if with_ids:
                        texts.append(bytes(own).decode("utf-8", "replace"))
                arrays = [pa.array(np.diff(edges)), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                labels = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(texts, pa.string())]
                    labels += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *arrays], [*names, *labels])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[c for c in out.columns if c not in names])
