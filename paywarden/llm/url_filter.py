"""URL rules by a bit-parallel wildcard automaton.

All rules are packed, one after another, into one bit row of as many 64-bit words as it takes. A rule of m symbols
has m + 1 states. Per byte, D = ((D << 1) & B[byte]) | (D & L[byte]): B holds the states that a byte may enter, L
those it may stay in (the wildcards). All URLs of a batch move along together, longest first, so that those at
their end drop off the tail; those whose states no byte can change leave early, and the last few go on as whole
numbers. A rule fits if its last state is set at the end.

Wildcards: `*` any run without `/`, `**` any run, `?` one byte but `/`. A rule (host, path) stands for the host and
all its subdomains and any path that starts with the rule's: over ".host/path" it is `*.host` + path + `**`. The
longest rule wins; without a rule the verdict is the default.

Defined cases: a null url or one without `://` has empty host and path and no rule; an empty path fits only rules
without path; ports and user names are part of the host, as no rule speaks of them; very long urls are read to
their end; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


class Automaton:
    """Shift-And masks of many globs."""

    def __init__(self, globs: list[str]):
        steps: list[list[tuple[set[int], set[int]]]] = []
        free = set(range(256)) - {ord("/")}
        for g in globs:
            raw, i = g.encode(), 0
            states: list[tuple[set[int], set[int]]] = [(set(), set())]  # (bytes that enter, bytes that stay)
            while i < len(raw):
                if raw[i] == ord("*"):
                    wide = raw[i : i + 2] == b"**"
                    states[-1][1].update(range(256) if wide else free)
                    i += 1 + wide
                else:
                    states.append((free if raw[i] == ord("?") else {raw[i]}, set()))
                    i += 1
            steps.append(states)
        bits = sum(map(len, steps))
        self.words = max(1, -(-bits // 64))
        self.enter, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.first, self.last = np.zeros(self.words, np.uint64), []
        at = 0
        for states in steps:
            self.first[at // 64] |= np.uint64(1 << (at % 64))
            for j, (enter, stay) in enumerate(states):
                w, bit = (at + j) // 64, np.uint64(1 << ((at + j) % 64))
                self.enter[list(enter), w] |= bit
                self.stay[list(stay), w] |= bit
            at += len(states)
            self.last.append(at - 1)

    def settled(self, state: np.ndarray) -> np.ndarray:
        """Which rows of states no byte can change any more."""
        ahead = state << np.uint64(1)
        ahead[:, 1:] |= state[:, :-1] >> np.uint64(63)
        moves = ahead & np.bitwise_or.reduce(self.enter, axis=0) & ~state
        leaves = state & ~np.bitwise_and.reduce(self.stay, axis=0)
        return ~(moves | leaves).any(axis=1)

    def _alone(self, state: np.ndarray, text: bytes) -> np.ndarray:
        number = lambda row: int.from_bytes(row.astype("<u8").tobytes(), "little")
        enter, stay = [number(x) for x in self.enter], [number(x) for x in self.stay]
        d = number(state)
        for i in range(0, len(text), 256):
            for c in text[i : i + 256]:
                d = ((d << 1) & enter[c]) | (d & stay[c])
            if self.settled(held := np.frombuffer(d.to_bytes(8 * self.words, "little"), np.uint64)[None])[0]:
                return held[0]
        return np.frombuffer(d.to_bytes(8 * self.words, "little"), np.uint64)

    def run(self, body: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """texts x globs: which globs fit each whole text."""
        sizes = np.diff(edges)
        order = np.argsort(-sizes, kind="stable")
        begin, size = edges[:-1][order], sizes[order]
        state = np.repeat(self.first[None], len(order), axis=0)
        act, t = np.arange(len(order)), 0
        while True:
            act = act[: int(np.searchsorted(-size[act], -t, side="left"))]
            if t % 64 == 0 and t:
                act = act[~self.settled(state[act])]
            if len(act) <= 2:
                break
            c = body[begin[act] + t]
            d = state[act]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[act] = (shifted & self.enter[c]) | (d & self.stay[c])
            t += 1
        for i in act.tolist():  # a few long ones: the same step on whole numbers
            state[i] = self._alone(state[i], body[begin[i] + t : begin[i] + size[i]].tobytes())
        fits = np.stack([(state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) for b in self.last], axis=1).astype(bool) if self.last else np.zeros((len(order), 0), bool)
        out = np.empty_like(fits)
        out[order] = fits
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(x, F.lit("")) for x in (F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns `keep`, host, path, rule (its host and path, or null) and verdict of each row."""
    names = [f"k{i}" for i in range(len(keep))]
    host, path = host_and_path(F.col(url))
    src = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], host.alias("host"), path.alias("path"))
    src = src.withColumn("line", F.concat(F.lit("."), "host", "path"))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names) + "host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = sorted(rules, key=lambda r: (-len(r.name), r.name))
        automaton = Automaton([r.glob for r in by_length])
        labels = np.array([*[r.name for r in by_length], None], object)
        verdicts = np.array([*[r.verdict for r in by_length], default], object)
        for whole in batches:
            for b in slices(whole, "line"):
                fits = automaton.run(*flat_bytes(b.column("line")))
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(by_length)) if by_length else np.zeros(b.num_rows, int)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in [*names, "host", "path"]], pa.array(labels[best], pa.string()), pa.array(verdicts[best], pa.string())],
                    [*names, "host", "path", "rule", "verdict"],
                )

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "host", "path", "rule", "verdict")
