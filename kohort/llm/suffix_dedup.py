"""Removal of long byte strings that occur more than once, by column-wise construction of suffix orders.

Every string of ``length`` bytes holds an anchor: the place in it where the hash of ``SEED`` bytes is least. Equal strings
have their anchors at the same offset, so it is enough to compare the surroundings of anchors whose seed is the same.
Surroundings are aligned at the anchor and treated as one collection of short documents: each round inserts one symbol per
document, from the last column to the first. The order of the suffixes that start in a column follows from the order one
column further right by a stable sort on the symbol inserted, and the common prefix of two neighbours is one more than the
least common prefix between their places before. Once a string of ``length`` bytes fits, neighbours that share it mark its
start. The columns lie in a temporary file of the task that is read from its end, one column a round; memory holds the
order, the prefixes and one column.

Copies of a whole text are folded first (a text of ``length`` bytes that occurs twice goes wholly); one of them stays as a
partner for others. An anchor of more than ``MAX_RUN`` places is not gathered: each string around it becomes a row of its
own (128-bit hash), counted by Spark with partial sums, which is exact too. Joins back to an anchor, a string or a text that
many rows share read written tables on both sides, so that Spark splits the partitions that they fill.

Nulls count as empty texts; a null id is kept; repeated rows are documents of their own with equal results; texts shorter
than ``length`` lose nothing; an empty table gives an empty one; clashing column names are replaced.
"""

from __future__ import annotations

import tempfile
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kohort.llm.arrow_text import BYTE_VALUES, mix, portions, prefix_hash, slices, small_batches, span_hash
from kohort.session import stage_table

SEED = 32
MAX_RUN = 20_000
ROUND_ROWS = 8_000
_NO_ID = -(1 << 63)
_OTHER_VALUES = mix(BYTE_VALUES + np.uint64(77))


def _least(values: np.ndarray, w: int, op=np.minimum, fill=np.uint64(0xFFFFFFFFFFFFFFFF)) -> np.ndarray:
    """The least of values[i : i + w] for every i; beyond the end counts as ``fill``."""
    n = len(values)
    blocks = -(-n // w) + 1
    padded = np.full(blocks * w, fill, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All anchors of the rows: (hash of the seed, place in the slice, row, start and end of the surroundings, twin, later).

    ``twin``: another anchor of the row has equal surroundings (128-bit hash) and stands at the same place in them (in a short
    text, two anchors may have the whole text around them); ``later``: an earlier one has, so that this one need not be
    compared again.
    """
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none.astype(bool), none.astype(bool)
    w = length - SEED + 1
    sums = prefix_hash(raw)
    at = np.arange(len(raw) - SEED + 1)
    seed = span_hash(sums, at, at + SEED)
    least = _least(seed, w)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(seed)]
    least[at + length > off[1:][row]] = 0
    # a place is an anchor if its hash is the least of a valid string that holds it
    most = _least(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    place = np.flatnonzero((most == seed) & (most > 0))
    hashes, rows = seed[place], row[place]
    left, right = np.maximum(off[rows], place - (w - 1)), np.minimum(off[rows + 1], place + length)
    around = span_hash(sums, left, right)
    ahead = place - left
    order = np.lexsort((place, ahead, around, rows))
    a, b = order[:-1], order[1:]
    equal = (rows[a] == rows[b]) & (around[a] == around[b]) & (ahead[a] == ahead[b]) & (right[a] - left[a] == right[b] - left[b])
    twin, later = np.zeros(len(place), dtype=bool), np.zeros(len(place), dtype=bool)
    if equal.any():
        second = span_hash(prefix_hash(raw, _OTHER_VALUES), left, right)
        equal &= second[a] == second[b]
        later[b[equal]] = True
        twin[a[equal]] = twin[b[equal]] = True
    return hashes, place, rows, left, right, twin, later


def suffix_rounds(symbols: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which a string of ``length`` symbols starts that another document of the group has there too.

    ``symbols``: a row for each document, 256 where it has no symbol; ``group``: ascending. -1 where there is none.
    """
    n, width = symbols.shape
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    base = group.astype(np.int64) << 9
    with tempfile.TemporaryFile() as columns:
        columns.write(np.ascontiguousarray(symbols.T, dtype=np.uint16).data)
        for c in range(width - 1, -1, -1):
            columns.seek(2 * n * c)
            symbol = np.frombuffer(columns.read(2 * n), dtype=np.uint16)[order]
            key = base + symbol
            step = np.argsort(key, kind="stable")
            key = key[step]
            equal = (key[1:] == key[:-1]) & ((key[1:] & 511) < 256)
            a, b = step[:-1] + 1, step[1:]
            least = common[b]
            far = np.flatnonzero(equal & (a != b))
            if len(far):
                spans = np.stack((a[far], b[far] + 1), axis=1).ravel()
                least[far] = np.minimum.reduceat(common, spans)[::2]
            common[1:n] = np.where(equal, np.minimum(least + 1, length), 0)
            common[0] = 0
            order = order[step]
            if c <= width - length:
                shared = common[:n] >= length
                shared[:-1] |= common[1:n] >= length
                who = order[shared]
                first[who] = c
                last[who] = np.maximum(last[who], c)
    return first, last


def _row_key(docs: DataFrame, id_column: str, text: str) -> list[Column]:
    """Columns that name a row: its id and a 128-bit hash of its text, never null; and its text."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.coalesce(F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16), F.lit(b""))
    return [F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_NO_ID)).alias("_id"), digest.alias("_key"), whole.alias("_text")]


def _find_anchors(length: int):
    def run(batches):
        for batch in batches:
            for a, b, raw, off in slices(batch.column(2), 1 << 18):
                hashes, place, rows, left, right, twin, later = anchors(raw, off, length)
                bounds = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
                lists: list[list] = [[], [], [], []]
                for r, (x, y) in enumerate(pairwise(bounds)):
                    first = ~later[x:y]
                    pair = twin[x:y]
                    # of anchors with equal surroundings in one text, all of those surroundings occur elsewhere
                    lo, hi = merge_spans(left[x:y][pair] - off[r], right[x:y][pair] - off[r])
                    for out, values in zip(lists, (hashes[x:y][first].view(np.int64), (place[x:y][first] - off[r]).astype(np.int32), lo, hi), strict=True):
                        out.append(values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(off)), *[pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]],
                    names=["_id", "_key", "n_bytes", "anchor", "place", "lo", "hi"],
                )

    return run


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; spans that touch become one."""
    if not len(lo):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    begin = np.ones(len(lo), dtype=bool)
    begin[1:] = lo[1:] > hi[:-1]
    end = np.append(np.flatnonzero(begin)[1:] - 1, len(lo) - 1)
    return lo[begin].astype(np.int32), hi[end].astype(np.int32)


def _cut(length: int, make):
    """``make`` of the surroundings of the wanted anchors of each text, in portions."""
    w = length - SEED

    def run(batches):
        for batch in portions(batches):
            ids, keys, texts, wanted = (batch.column(i).to_pylist() for i in range(4))
            rows: list[tuple] = []
            size = 0
            for i, key, text, places in zip(ids, keys, texts, wanted, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for q in places:
                    p = q["place"]
                    a, b = max(0, p - w), min(len(data), p + length)
                    rows.append((q["anchor"], i, key, p, data[a:b], p - a))
                    size += b - a
                if size > (1 << 18):
                    yield make(rows)
                    rows, size = [], 0
            if rows:
                yield make(rows)

    return run


_SEGMENT = T.StructType().add("anchor", "long").add("_id", "long").add("_key", "binary").add("place", "integer").add("seg", "binary").add("ahead", "integer")
_SPAN = T.StructType().add("_id", "long").add("_key", "binary").add("lo", "integer").add("hi", "integer")


def _segments(rows):
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_SEGMENT.names)


def _compare(length: int):
    """Spans of each segment that another segment with the same anchor has too. Input is sorted by anchor."""
    w = length - SEED
    width = w + length

    def work(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        anchor = part.column("anchor").to_numpy()
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        raw, off = _bytes(part.column("seg"))
        ahead, place = part.column("ahead").to_numpy(), part.column("place").to_numpy()
        symbols = np.full((len(anchor), width), 256, dtype=np.uint16)
        for row, (a, b, c) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), (w - ahead).tolist(), strict=True)):
            symbols[row, c : c + b - a] = raw[a:b]
        first, last = suffix_rounds(symbols, group, length)
        hit = np.flatnonzero(first >= 0)
        lo = place[hit] - w + first[hit]
        hi = place[hit] - w + last[hit] + length
        return pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(hit)).combine_chunks(), part.column("_key").take(pa.array(hit)).combine_chunks(), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=_SPAN.names)

    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= ROUND_ROWS:
                both = pa.concat_tables(held)
                anchor = both.column("anchor").to_numpy()
                stop = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
                if stop:
                    yield work(both.slice(0, stop))
                held = [both.slice(stop)]
                rows -= stop
        if rows:
            yield work(pa.concat_tables(held))

    return run


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    arr = column.combine_chunks()
    arr = (arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr).cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


_STRING = T.StructType().add("h1", "long").add("h2", "long").add("_id", "long").add("_key", "binary").add("lo", "integer")


def _strings(length: int):
    """Every string of ``length`` bytes in the segments, by two hashes."""

    def make(rows):
        part = pa.Table.from_batches([_segments(rows)])
        raw, off = _bytes(part.column("seg"))
        size = np.maximum(np.diff(off) - length + 1, 0)
        r = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) + off[:-1][r]
        hashes = [span_hash(prefix_hash(raw, values), at, at + length).view(np.int64) for values in (BYTE_VALUES, _OTHER_VALUES)]
        lo = (part.column("place").to_numpy() - part.column("ahead").to_numpy())[r] + at - off[:-1][r]
        take = pa.array(r)
        return pa.RecordBatch.from_arrays([pa.array(hashes[0]), pa.array(hashes[1]), part.column("_id").take(take).combine_chunks(), part.column("_key").take(take).combine_chunks(), pa.array(lo, pa.int32())], names=_STRING.names)

    return make


def repeated_spans(rows: DataFrame, length: int, max_run: int = MAX_RUN) -> tuple[DataFrame, DataFrame]:
    """``rows``: _id, _key, _text, _row. Gives (spans of texts that occur once or stand for their copies, facts of each row).

    Facts: _id, _key, n_bytes, copies (rows with this text) and stands (this row's id is the least of them).
    """
    found = stage_table(rows.mapInArrow(_find_anchors(length), "_id bigint, _key binary, n_bytes bigint, anchor array<bigint>, place array<int>, lo array<int>, hi array<int>"), "anchors")
    classes = stage_table(found.groupBy("_key").agg(F.count("*").alias("copies"), F.min("_id").alias("least")), "classes")
    facts = found.select("_id", "_key", "n_bytes").join(classes, "_key").select("_id", "_key", "n_bytes", "copies", (F.col("_id") == F.col("least")).alias("stands")).distinct()
    # the lists of copies stay behind: only one row of each text is looked up, by id and text
    lone = found.join(classes.select("_key", F.col("least").alias("_id")), ["_key", "_id"], "left_semi")
    places = lone.select("_id", "_key", F.explode(F.arrays_zip("anchor", "place")).alias("x")).select("_id", "_key", "x.anchor", "x.place")
    occurrence = F.xxhash64("_key", "place")
    counts = places.groupBy("anchor").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"), F.count("*").alias("n"))
    shared = stage_table(counts.where("a <> b").select("anchor", (F.col("n") > max_run).alias("big")), "shared")
    wanted = stage_table(places.join(shared, "anchor").groupBy("_id", "_key", "big").agg(F.collect_set(F.struct("anchor", "place")).alias("wanted")), "wanted")

    def cut(big: bool, make, schema: T.StructType) -> DataFrame:
        # the rows are read with all their columns, so that this shuffle of the texts is also that of the last join
        return rows.join(wanted.where(F.col("big") == big).drop("big"), ["_id", "_key"]).select("_id", "_key", "_text", "wanted", "_row").mapInArrow(_cut(length, make), schema)

    small = cut(False, _segments, _SEGMENT).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), _SPAN)
    strings = cut(True, _strings(length), _STRING)
    own = F.xxhash64("_key", "lo")
    twice = stage_table(strings.groupBy("h1", "h2").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("h1", "h2"), "strings")
    large = strings.join(twice, ["h1", "h2"]).select("_id", "_key", "lo", (F.col("lo") + length).alias("hi"))
    inner = lone.where(F.size("lo") > 0).select("_id", "_key", F.explode(F.arrays_zip("lo", "hi")).alias("x")).select("_id", "_key", "x.lo", "x.hi")
    return small.unionByName(large).unionByName(inner), facts


def _kept(docs: DataFrame, length: int, id_column: str, text: str, max_run: int, least_words: int = 0) -> DataFrame:
    """``_row`` (all columns of ``docs``), n_bytes, n_removed, n_spans and kept (binary)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*_row_key(docs, id_column, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    spans, facts = repeated_spans(rows, length, max_run)
    covered = spans.groupBy("_id", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    marks = facts.join(covered, ["_id", "_key"], "left").withColumn("whole", (F.col("copies") > 1) & (F.col("n_bytes") >= length)).where("whole or spans is not null").select("_id", "_key", "whole", "spans")
    full = rows.join(marks, ["_id", "_key"], "left").select("_row", "_text", "whole", "spans")

    def run(batches):
        for batch in portions(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            texts, whole, spans = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for t, all_of_it, marked in zip(texts, whole, spans, strict=True):
                data = t.encode("utf-8", "surrogatepass")
                lo: list[int] = []
                hi: list[int] = []
                if all_of_it:
                    lo, hi = [0], [len(data)]
                elif marked:
                    lo, hi = (x.tolist() for x in merge_spans(np.array([m["lo"] for m in marked]), np.array([m["hi"] for m in marked])))
                if least_words:
                    long = [(a, b) for a, b in zip(lo, hi, strict=True) if len(data[a:b].split()) >= least_words]
                    lo, hi = [a for a, _ in long], [b for _, b in long]
                n_bytes.append(len(data))
                n_removed.append(sum(hi) - sum(lo))
                n_spans.append(len(lo))
                kept.append(b"".join(data[a:b] for a, b in zip([0, *hi], [*lo, len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([rows.schema["_row"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return full.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """All columns of ``docs`` and: n_bytes, n_removed, n_spans, kept (binary: the bytes that stay, in order)."""
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    return _kept(docs, length, id_column, text, max_run).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def without_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text: str = "text", least_words: int = 0) -> DataFrame:
    """``docs`` with the bytes that stay as their text; characters of which a byte went are dropped. A null text becomes empty.

    With ``least_words``, a maximal run of removed bytes goes only if it holds so many words (of bytes between white space).
    """
    found = _kept(docs, length, id_column, text, MAX_RUN, least_words).select("_row", "kept")
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in portions(batches):
            columns = batch.column(0).flatten()
            columns[at] = pa.array([k.decode("utf-8", "ignore") for k in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, docs.schema)
