"""Encoding of whole texts piece by piece, with a compact table of the pieces met before.

A text is cut before a space whose left or right neighbour is no white space; byte-level tokenizers that split with the
usual pattern always split there, so the pieces may be encoded one by one. Each distinct piece of a slice is looked up
once in a sorted table (64-bit hash of its bytes -> ids) and only unknown ones are encoded. The table is kept between
the tasks of a worker and bounded; when full, it starts again from the pieces of the slice at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from kohort.llm.arrow_text import prefix_hash, span_hash

MAX_ENTRIES = 1_000_000
SLICE = 1 << 19
#: Bytes that are surely no white space: printable ASCII.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
#: The same for the first byte of a character: white space beyond ASCII starts with C2, E1, E2 or E3.
_SOLID_NEXT = _SOLID.copy()
_SOLID_NEXT[0xC3:0xF5] = True
_SOLID_NEXT[[0xE1, 0xE2, 0xE3]] = False


def cut(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pieces, and the index of the first piece of every row (one entry more than rows)."""
    space = np.flatnonzero(raw == 32)
    left = _SOLID[raw[space - 1]] & (space > 0) if len(space) else np.zeros(0, bool)
    right = _SOLID_NEXT[raw[np.minimum(space + 1, len(raw) - 1)]] & (space + 1 < len(raw)) if len(space) else left
    is_start = np.zeros(len(raw) + 1, dtype=bool)
    is_start[space[left | right]] = True
    # a space before the end of a row has its right neighbour in the next row
    last = off[1:-1] - 1
    last = last[last >= 0]
    at_end = last[raw[last] == 32] if len(last) else last
    is_start[at_end] = _SOLID[raw[at_end - 1]] & (at_end > 0)
    filled = off[:-1][off[1:] > off[:-1]]
    is_start[filled] = True
    starts = np.flatnonzero(is_start[:-1])
    return starts, np.searchsorted(starts, off)


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - counts)).astype(kind), counts)
    out += np.arange(total, dtype=kind)
    return out


class PieceTable:
    """``encode`` takes pieces and gives all their ids one after another, and each piece's number of ids."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = MAX_ENTRIES):
        self.encode, self.limit = encode, limit
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's number of ids."""
        starts, first = cut(raw, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        ends = np.append(starts[1:], len(raw))
        hashes = span_hash(prefix_hash(raw), starts, ends)
        keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            whole = raw.tobytes()
            ids, count = self.encode([whole[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            self._add(keys, known, place, keys[new], ids, count)
            place = np.searchsorted(self.keys, keys)
        counts = self.count[place][inverse]
        ids = self.flat[gather(self.start[place][inverse], counts)]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(sums[first])

    def _add(self, keys, known, place, new, ids, count) -> None:
        if len(self.keys) + len(new) > self.limit:  # keep what this slice has
            keep = place[known]
            self.flat = self.flat[gather(self.start[keep], self.count[keep])]
            self.count = self.count[keep]
            self.start = np.cumsum(self.count) - self.count
            self.keys = keys[known]
        start = np.cumsum(count) - count + len(self.flat)
        spot = np.searchsorted(self.keys, new)
        self.keys = np.insert(self.keys, spot, new)
        self.start = np.insert(self.start, spot, start)
        self.count = np.insert(self.count, spot, count)
        self.flat = np.concatenate([self.flat, ids])
