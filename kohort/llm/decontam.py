"""Benchmark decontamination: documents that hold a benchmark item, or one within a given edit distance.

Texts are compared as sequences of words (letters and digits, A-Z as a-z; ASCII signs and white space separate). An item of n
words is found where a run of a document's words is within ``rate`` * n word edits of it (rounded down).

Windows of an item's size are embedded by CGK random walks: a walk reads a window word by word for 3n steps, writes the word
it stands on, and steps on or stays as a random function of step and word says. Walks of similar sequences mostly meet again,
so a small edit distance becomes a small Hamming distance. ``walks`` walks with ``tables`` samples of two places each give the
buckets; a window in a bucket of an item is verified by exact edit distance over the words around it. Equal windows always
meet; with these defaults, windows within the limit are missed less than once in a hundred (measured in the tests).

Windows at which no item can start are not embedded: sequences within e edits share n - q + 1 - e q runs of q words, on
neighbouring diagonals, so windows whose surroundings hold fewer such runs are passed over without loss. Items are broadcast
in blocks of at most ``BLOCK_BYTES`` of text; documents are never shuffled.

Null and empty texts hold nothing; null items and items of fewer than ``least_words`` words are not searched; repeated rows
are judged alike; rows with a null id are judged too; empty tables give no rows. Clashing column names do not matter.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kohort.llm.arrow_text import FOLDED_VALUES, mix, prefix_hash, runs_hash, slices, small_batches, span_hash, words

RATE = 0.2
LEAST_WORDS = 5
WALKS = 6
TABLES = 8
PLACES = 2
BLOCK_BYTES = 8 << 20
_PAD = np.uint64(1)
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(raw, off, _APART)
    return span_hash(prefix_hash(raw, FOLDED_VALUES), start, end), first


def embed(windows: np.ndarray, walk: int, seed: int = 7) -> np.ndarray:
    """The words on which a walk over each window stands at each of 3n steps."""
    m, n = windows.shape
    padded = np.concatenate((windows, np.full((m, 1), _PAD)), axis=1)
    at, row = np.zeros(m, dtype=np.int64), np.arange(m)
    out = np.empty((m, 3 * n), dtype=np.uint64)
    keys = mix(np.arange(3 * n, dtype=np.uint64) + np.uint64((seed * 1009 + walk) << 20))
    for j in range(3 * n):
        here = padded[row, at]
        out[:, j] = here
        at = np.minimum(at + (mix(here ^ keys[j]) & np.uint64(1)).astype(np.int64), n)
    return out


def buckets(windows: np.ndarray, walks: int = WALKS, tables: int = TABLES, seed: int = 7) -> np.ndarray:
    """A bucket for each window, walk and table: the hash of the words at the sampled places."""
    m, n = windows.shape
    rng = np.random.default_rng(seed * 100_003 + n)
    out = np.empty((m, walks * tables), dtype=np.uint64)
    for r in range(walks):
        steps = embed(windows, r, seed)
        for t in range(tables):
            places = rng.integers(0, 3 * n, PLACES)
            value = np.full(m, r * tables + t + 1, dtype=np.uint64)
            for p in places:
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + steps[:, p])
            out[:, r * tables + t] = value
    return out


def best_span(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of ``region`` nearest to ``item``; the first of equals.

    A cell of the usual table holds edits * 2**32 + start, so that one minimum decides both.
    """
    one = 1 << 32
    cell = np.arange(len(region) + 1, dtype=np.int64)
    steps = np.arange(len(region) + 1, dtype=np.int64) * one
    for w in item:
        new = cell + one
        new[1:] = np.minimum(new[1:], cell[:-1] + one * (region != w))
        cell = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(cell >> 32))
    return int(cell[end] >> 32), int(cell[end] & (one - 1)), end


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], rate: float, least_words: int, walks: int, tables: int):
        self.rate, self.walks, self.tables = rate, walks, tables
        raw = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts]))).astype(np.int64)
        hashes, first = word_hashes(raw, off)
        self.ids, self.words = [], []
        for i, a, b in zip(ids, first[:-1], first[1:], strict=True):
            if b - a >= max(1, least_words):
                self.ids.append(i)
                self.words.append(hashes[a:b])
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.edits = np.array([int(rate * n + 1e-9) for n in self.size], dtype=np.int64)
        self.q = np.array([max([q for q in (1, 2, 3) if n - q + 1 - e * q >= 1], default=1) for n, e in zip(self.size, self.edits, strict=True)], dtype=np.int64)
        self.shared = np.maximum(self.size - self.q + 1 - self.edits * self.q, 1)
        self.runs = {}
        for q in np.unique(self.q).tolist():
            own = [(h, x, k) for x in np.flatnonzero(self.q == q).tolist() for k, h in enumerate(runs_hash(self.words[x], q))]
            h = np.array([o[0] for o in own], dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            marks = np.zeros(1 << 20, dtype=bool)
            marks[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.runs[q] = marks, h[order], np.array([o[1] for o in own])[order], np.array([o[2] for o in own])[order]
        self.index = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            table = buckets(np.stack([self.words[x] for x in own]), walks, tables)
            keys, who = table.ravel(), np.repeat(own, table.shape[1])
            order = np.argsort(keys, kind="stable")
            self.index[n] = keys[order], who[order]

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size, the (row, start) of the windows at which an item of that size may stand."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (marks, keys, item, offset) in self.runs.items():
            runs = runs_hash(hashes, q)
            hit = np.flatnonzero(marks[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
            a, b = np.searchsorted(keys, runs[hit], "left"), np.searchsorted(keys, runs[hit], "right")
            hit, a, b = hit[b > a], a[b > a], b[b > a]
            row = np.searchsorted(first, hit, side="right") - 1
            inside = hit + q <= first[row + 1]
            hit, a, b, row = hit[inside], a[inside], b[inside], row[inside]
            times = b - a
            each = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)
            who, start, row = item[each], np.repeat(hit, times) - offset[each], np.repeat(row, times)
            order = np.lexsort((start, who, row))
            who, start, row = who[order], start[order], row[order]
            # diagonals on which the runs around are as many as the limit of edits leaves
            group = np.cumsum(np.concatenate(([0], (who[1:] != who[:-1]) | (row[1:] != row[:-1])))) if len(who) else np.zeros(0, np.int64)
            span = int(self.edits.max(initial=0)) + 1
            line = group * (len(hashes) + 4 * span + int(self.size.max(initial=0)) + 8) + start
            # all runs of one occurrence lie within e diagonals of its start on either side, so within 2e of each other
            reach = 2 * self.edits[who]
            enough = np.searchsorted(line, line + reach, "right") - np.searchsorted(line, line - reach, "left") >= self.shared[who]
            for n in np.unique(self.size[who[enough]]).tolist():
                mine = enough & (self.size[who] == n)
                found.setdefault(n, []).append(np.stack((row[mine], start[mine]), axis=1))
        return {n: np.unique(np.concatenate(x), axis=0) for n, x in found.items()}

    def search(self, raw: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(row, place of the item in the block): (edits, start word, end word)}, the best of each."""
        hashes, first = word_hashes(raw, off)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        near: dict[tuple[int, int], list[int]] = {}
        for n, spots in self.windows(hashes, first).items():
            padded = np.concatenate((hashes, np.full(1, _PAD)))
            keys, who = self.index[n]
            for k in range(0, len(spots), 2048):
                some = spots[k : k + 2048]
                at = some[:, 1:] + np.arange(n)
                outside = (at < first[some[:, 0]][:, None]) | (at >= first[some[:, 0] + 1][:, None])
                table = buckets(padded[np.where(outside, len(hashes), at)], self.walks, self.tables)
                a, b = np.searchsorted(keys, table, "left"), np.searchsorted(keys, table, "right")
                pairs = {(int(w), int(x)) for w, c in zip(*np.nonzero(b > a), strict=True) for x in who[a[w, c] : b[w, c]]}
                for w, x in pairs:
                    row, start = some[w].tolist()
                    near.setdefault((row, x), []).append(start)
        for (row, x), starts in near.items():
            n, e = int(self.size[x]), int(self.edits[x])
            starts.sort()
            cuts = [0, *[i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > n], len(starts)]
            for a, b in pairwise(cuts):  # windows that overlap are verified together
                lo, hi = max(int(first[row]), starts[a] - 2 * e), min(int(first[row + 1]), starts[b - 1] + n + 2 * e)
                cost, begin, end = best_span(self.words[x], hashes[lo:hi])
                if cost <= e:
                    here = (cost, lo + begin - int(first[row]), lo + end - int(first[row]))
                    best[row, x] = min(best.get((row, x), here), here)
        return best


def blocks(benchmark: DataFrame, rate: float, least_words: int, walks: int, tables: int, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """The items in broadcast blocks of bounded size, one after another."""
    small_batches(benchmark.sparkSession)
    items = benchmark.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t") + 16).alias("s")).first().s or 0
    parts = max(1, -(-int(size) // block_bytes))
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r.i for r in own], [r.t for r in own], rate, least_words, walks, tables))


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, walks: int = WALKS, tables: int = TABLES, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_words, edits, start_word, end_word: the best place of every item in every document that holds it."""
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for shared in blocks(benchmark, rate, least_words, walks, tables, block_bytes=block_bytes):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                ids = batch.column(0)
                for a, _, raw, off in slices(batch.column(1)):
                    hits = items.search(raw, off) if items.ids else {}
                    keys = sorted(hits)
                    take = pa.array([a + r for r, _ in keys], pa.int64())
                    columns = [ids.take(take), pa.array([items.ids[x] for _, x in keys], pa.int64()), pa.array([int(items.size[x]) for _, x in keys], pa.int64())]
                    columns += [pa.array([hits[k][c] for k in keys], pa.int64()) for c in range(3)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_words", "edits", "start_word", "end_word"])

        found = source.mapInArrow(run, "doc_id long, item_id long, n_words long, edits long, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, walks: int = WALKS, tables: int = TABLES, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds an item. No shuffle."""
    at = docs.columns.index(text)
    for shared in blocks(benchmark, rate, least_words, walks, tables, block_bytes=block_bytes):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for a, _, raw, off in slices(batch.column(at)):
                    for row, _ in items.search(raw, off) if items.ids else ():
                        clean[a + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
