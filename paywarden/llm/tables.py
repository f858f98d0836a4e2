"""A read-only hash table of 64-bit keys for whole arrays of look-ups."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(2**64 - 1)


class KeyTable:
    """Integer values of distinct uint64 keys (none of which is 2**64 - 1); linear probing over whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, _FREE)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._home(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.keys[at] == _FREE
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= free
            self.keys[at[mine]] = keys[todo[mine]]
            self.values[at[mine]] = values[todo[mine]]
            todo, step = todo[~mine], step + 1
        self.probes = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != _FREE))
        step = 1
        while len(open_):
            at = (self._home(keys[open_]) + step) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found != _FREE) & (step < self.probes)]
            step += 1
        return out
