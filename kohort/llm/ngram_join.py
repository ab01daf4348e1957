"""Exact self-join of documents on the Jaccard similarity of their word shingles, as linked components.

1. Every text becomes the sorted set of the 64-bit hashes of its shingles. Equal sets are folded into one, whose id is the
   least of their ids. The same pass fills a table of ``CELLS`` counters (fixed size) with all shingles.
2. Shingles are put into one order for all sets: those in well-filled counters last, then by hash. Two similar sets share
   shingles near the start of this order (prefix filter): at least ``ell`` of them, which follows from both sizes. Sets that
   share fewer are dropped; the rest gives families, a superset of what can be linked.
3. Each family is dealt into tiles by size band and, where a band is large, by hash. Every set has a bitmap of its hashed
   shingles, of one to two bits a shingle; the bits in which two bitmaps differ bound the overlap from above. The pairs that
   pass split the families into finer ones, for which no set has been moved yet.
4. Finer families are dealt into tiles likewise, with the sets themselves: wider bitmaps bound the overlap again, and pairs
   that pass are intersected exactly, as sorted arrays. Pairs that are connected already are not compared.
5. In both steps large families first meet a tile's worth of pivots; only what is not in the largest component then goes on
   to meet the others. So a group of near copies costs about its size, and no pair is left out that could join two components.

Rows with a null text have an empty set and stand alone. A row with a null id has a null component and links nothing. Rows
that share an id are one document. Repeated rows stay repeated in the result. Columns other than id and text play no part.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kohort.llm.arrow_text import FOLDED_VALUES, mix, prefix_hash, runs_hash, slices, span_hash, words
from kohort.llm.graph import components
from kohort.llm.sieve import sifted
from kohort.session import stage_table

WORDS = 5
NUM, DEN = 75, 100
CELLS = 1 << 22
CHUNKS = 64
RUN_PAIRS = 32
HELD_ROWS = 50_000
TILE = 512


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    start, end, first = words(raw, off)
    hashes = span_hash(prefix_hash(raw, FOLDED_VALUES), start, end)
    runs = runs_hash(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(runs_hash(hashes[a:b], b - a))
        else:
            out.append(hashes[:0])
    return out


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set."""
    one = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=np.uint64)
    two = np.array([np.add.reduce(mix(s ^ np.uint64(0x5BD1E995))) if len(s) else 0 for s in sets], dtype=np.uint64)
    return one.view(np.int64), two.view(np.int64)


def least_overlap(total, num: int, den: int):
    """Least overlap of two sets with that many shingles together."""
    return -(-num * total // (num + den))


def width(n: int, factor: int = 1) -> int:
    """Bits of the bitmap of n shingles: the power of two from ``factor`` a shingle on."""
    return max(64, 1 << int(factor * n - 1).bit_length()) if n else 64


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of a set; one of half the width is the first half or-ed with the second."""
    marks = np.zeros(bits, dtype=np.uint8)
    marks[(mix(items) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks).view(np.uint64)


_MEASURED = ["_id", "n", "k1", "k2", "chunk", "bits"]


def _measure():
    def run(batches):
        cells = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                sets = shingle_sets(raw, off)
                spots, many = np.unique((np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(CELLS - 1)).astype(np.int32), return_counts=True)
                cells[spots] += many.astype(np.int32)
                one, two = _keys(sets)
                m = b - a
                maps = pa.array([bitmap(s, width(len(s))).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), pa.nulls(m, pa.int32()), maps], names=_MEASURED)
        parts = cells.reshape(CHUNKS, -1)
        if cells.any():
            null = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=_MEASURED)

    return run


def _add_cells(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for c in batch.column(batch.schema.get_field_index("bits")).to_pylist():
            part = np.frombuffer(zlib.decompress(c), dtype=np.int32).astype(np.int64)
            total = part if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["chunk", "total", "cells"])


def _levels(measured: DataFrame) -> np.ndarray:
    """For each counter 0, or 1 + log2 of its count where that stands out. Always ``CELLS`` bytes."""
    added = measured.where("chunk is not null").select("chunk", "bits").groupBy("chunk").applyInArrow(_add_cells, "chunk int, total long, cells binary")
    rows = added.collect()  # CHUNKS rows of a fixed size
    mean = sum(r.total for r in rows) / CELLS
    out = np.zeros(CELLS, dtype=np.uint8)
    size = CELLS // CHUNKS
    for r in rows:
        cells = np.frombuffer(zlib.decompress(r.cells), dtype=np.int64)
        high = cells > mean + 6 * np.sqrt(mean + 1) + 4
        out[r.chunk * size : (r.chunk + 1) * size][high] = 1 + np.log2(cells[high]).astype(np.uint8)
    return out


def spare(n):
    """By how many shingles a start is longer than two similar sets need to share one."""
    return 2 + (3 * n + 99) // 100


def _prefixes(levels, num: int, den: int):
    def run(batches):
        order = levels.value
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                sets = shingle_sets(raw, off)
                one, two = _keys(sets)
                starts = []
                for s in sets:
                    k = len(s) - -(-num * len(s) // den) + 1 + spare(len(s)) if len(s) else 0
                    level = order[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                    starts.append((s[np.argsort(level, kind="stable")[:k]] if level.any() else s[:k]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array(one), pa.array(two), pa.array(starts, pa.list_(pa.int64()))], names=["_id", "n", "k1", "k2", "start"])

    return run


_PAIR = "token long, a long, b long, na int, nb int"


def _pairs_of_runs(num: int, den: int, run_pairs: int):
    """Pairs of sets that share a narrow token, and a row (token, set) for each set with a wide one. Input is sorted by token."""

    def work(token, ids, n, wide_token):
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(start, len(token)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        wide = (size > run_pairs) | (token[start] == wide_token)
        for m in np.unique(size[(size > 1) & ~wide]):
            s = start[(size == m) & ~wide]
            i, j = np.triu_indices(m, 1)
            left.append((s[:, None] + i).ravel())
            right.append((s[:, None] + j).ravel())
        x, y = np.concatenate(left), np.concatenate(right)
        near = (den * np.minimum(n[x], n[y]).astype(np.int64) >= num * np.maximum(n[x], n[y]).astype(np.int64)) & (ids[x] != ids[y])
        x, y = x[near], y[near]
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        z = np.flatnonzero(np.repeat(wide, size))
        pairs = pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(ids[x]), pa.array(ids[y]), pa.array(n[x]), pa.array(n[y])], names=["token", "a", "b", "na", "nb"])
        rows = pa.RecordBatch.from_arrays([pa.array(token[z]), pa.array(ids[z]), pa.nulls(len(z), pa.int64()), pa.array(n[z]), pa.nulls(len(z), pa.int32())], names=pairs.schema.names)
        return [b for b in (pairs, rows) if b.num_rows]

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        wide_token = None
        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            rows = len(held[0])
            end = int(np.searchsorted(held[0], held[0][-1])) if rows else 0
            if rows - end > HELD_ROWS:  # one token in very many sets: it is wide, however many are to come
                end, last = rows, held[0][-1]
                yield from work(*held, last)
                wide_token = last
            elif end:
                yield from work(*[x[:end] for x in held], wide_token)
            held = [x[end:] for x in held]
        if len(held[0]):
            yield from work(*held, wide_token)

    return run


def _candidates(tokens: DataFrame, num: int, den: int, run_pairs: int) -> DataFrame:
    """a, b: pairs that connect all sets which may be linked. ``tokens``: token, _id, n."""
    found = stage_table(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_pairs_of_runs(num, den, run_pairs), _PAIR), "shared")
    wide = found.where("b is null").select("token", F.col("a").alias("_id"), F.col("na").alias("n")).distinct()
    extra = lambda n: 2 + F.floor((3 * F.col(n) + 99) / 100)  # noqa: E731  as spare()
    beyond = lambda n: F.least(F.lit(0), 1 + extra(n) - F.ceil(F.col(n) * num / float(den) - 1e-9))  # noqa: E731  of a start, less the set
    many = wide.groupBy("_id", "n").agg(F.count("*").alias("w"))
    side = lambda x: many.groupBy(F.col("_id").alias(x)).agg(F.max("w").alias(f"w{x}"))
    counted = found.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).join(side("a"), "a", "left").join(side("b"), "b", "left")
    ell = F.ceil((F.col("na") + F.col("nb")) * num / float(num + den) - 1e-9) + F.least(beyond("na"), beyond("nb"))
    pairs = counted.where(F.col("c") + F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0))) >= ell).select("a", "b")
    # two sets that share wide tokens only have at least ell of them each, and ell is more than the spare ones of the smaller set
    chained = wide.join(many.where(F.col("w") > F.floor(extra("n") * num / float(den))).select("_id").distinct(), "_id")
    beside = Window.partitionBy("token").orderBy("n", "_id")
    links = chained.select(F.col("_id").alias("b"), "n", F.lag("_id").over(beside).alias("a"), F.lag("n").over(beside).alias("m"))
    return pairs.unionByName(links.where(F.col("m") * den >= F.col("n") * num).select("a", "b"))


def band(n: str, num: int, den: int):
    """Sets that may be linked are in the same or in neighbouring bands."""
    return F.floor(F.log(F.col(n).cast("double")) / float(np.log(den / num)) - 1e-9).cast("int")


def _dealt(members: DataFrame, size: int) -> DataFrame:
    """``members``: _id, k1, k2, n, fam, band, pivot, comp. Adds ``tiles``, the tiles in which each must be compared.

    A pivot meets all pivots and all others of its band and the two beside it; the others do not meet each other.
    """
    counts = members.groupBy("fam", "band").agg(F.ceil(F.sum(F.col("pivot").cast("int")) / size).alias("p"), F.ceil(F.sum((~F.col("pivot")).cast("int")) / size).alias("o"))
    own = members.join(counts, ["fam", "band"]).withColumn("sub", F.pmod(F.xxhash64("_id", "k1"), F.greatest(F.when(F.col("pivot"), F.col("p")).otherwise(F.col("o")), F.lit(1)))).drop("p", "o")
    beside = own.withColumn("there", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    there = counts.select("fam", F.col("band").alias("there"), "p", "o")
    none = F.array().cast("array<struct<pivot:boolean,sub:bigint>>")
    units = F.concat(
        F.when(F.col("p") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda x: F.struct(F.lit(True).alias("pivot"), x.alias("sub")))).otherwise(none),
        F.when(F.col("pivot") & (F.col("o") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("o") - 1), lambda x: F.struct(F.lit(False).alias("pivot"), x.alias("sub")))).otherwise(none),
    )
    met = beside.join(there, ["fam", "there"]).withColumn("unit", F.explode(units))
    here, other = F.struct(F.col("band"), F.col("pivot"), F.col("sub")), F.struct(F.col("there").alias("band"), F.col("unit.pivot").alias("pivot"), F.col("unit.sub").alias("sub"))
    tile = F.xxhash64("fam", F.least(here, other), F.greatest(here, other))
    return met.groupBy("_id", "k1", "k2").agg(F.collect_set(tile).alias("tiles"), F.first("pivot").alias("pivot"), F.first("comp").alias("comp"), F.first("n").alias("n"))


_FOUND = "a long, b long"


def _tiles(work):
    """Runs ``work`` (ids, pivot, comp, n, items -> links) on every tile. Input: tile, _id, pivot, comp, n, items, sorted by tile."""

    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            links = []
            for t, *row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if t != at:
                    if len(held) > 1:
                        links += work(*zip(*held, strict=True))
                    at, held = t, []
                held.append(row)
            yield batch_of(links)
        if len(held) > 1:
            yield batch_of(work(*zip(*held, strict=True)))

    return run


class _Joined:
    """Which sets of a tile are connected, and the links that connected them."""

    def __init__(self, ids, comp):
        self.ids = ids
        self.label = np.unique(np.array(comp, dtype=np.int64), return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def link(self, i: int, j: int) -> None:
        if self.label[i] != self.label[j]:
            self.links.append((self.ids[i], self.ids[j]))
            self.label[self.label == self.label[j]] = self.label[i]


def bound_tile(ids, pivot, comp, n, items, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Pairs whose bitmaps do not rule out a link, as many as it takes to connect them."""
    order = sorted(range(len(ids)), key=lambda i: (n[i], ids[i]))
    joined = _Joined([ids[i] for i in order], [comp[i] for i in order])
    pivot, n = np.array([pivot[i] for i in order]), np.array([n[i] for i in order], dtype=np.int64)
    maps = [np.frombuffer(items[i], dtype=np.uint64) for i in order]
    words = np.array([len(m) for m in maps])
    # sorted by size, sets of one width stand together; a link reaches into the same width and the next
    first = {int(w): int(np.flatnonzero(words == w)[0]) for w in np.unique(words)}
    same = {w: np.stack([m for m in maps if len(m) == w]) for w in first}
    halved = {w: same[w][:, : w // 2] | same[w][:, w // 2 :] for w in first if w > 1}
    for i in range(len(ids) - 1):
        stop = int(np.searchsorted(n, den * n[i] // num, side="right"))
        w = int(words[i])
        for other, table in ((w, same[w]), (2 * w, halved.get(2 * w))):
            if table is None:
                continue
            a = max(i + 1, first[other])
            b = min(stop, first[other] + len(table))
            for k in range(a, b, 512):
                j = np.arange(k, min(b, k + 512))
                j = j[(joined.label[j] != joined.label[i]) & (pivot[j] | pivot[i])]
                differ = np.bitwise_count(table[j - first[other]] ^ maps[i]).sum(axis=1).astype(np.int64)
                both = n[j] + n[i]
                for x in j[(both - differ) // 2 >= least_overlap(both, num, den)].tolist():
                    joined.link(i, x)
    return joined.links


def join_tile(ids, pivot, comp, n, items, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links that join the sets of a tile into the components they form; sets with equal ``comp`` count as joined."""
    order = sorted(range(len(ids)), key=lambda i: (n[i], ids[i]))
    joined = _Joined([ids[i] for i in order], [comp[i] for i in order])
    pivot, n = np.array([pivot[i] for i in order]), np.array([n[i] for i in order], dtype=np.int64)
    sets = [np.frombuffer(items[i], dtype=np.uint64) for i in order]
    bits = width(int(n.max()), 2)
    maps = np.stack([bitmap(s, bits) for s in sets])
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(n, den * n[i] // num, side="right"))
        for k in range(i + 1, stop, 256):
            j = np.arange(k, min(stop, k + 256))
            j = j[(joined.label[j] != joined.label[i]) & (pivot[j] | pivot[i])]
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1).astype(np.int64)
            both = n[j] + n[i]
            for x in j[(both - differ) // 2 >= least_overlap(both, num, den)].tolist():
                if joined.label[x] != joined.label[i]:
                    spot = np.searchsorted(sets[x], sets[i])
                    spot[spot == n[x]] = 0
                    shared = int((sets[x][spot] == sets[i]).sum())
                    if den * shared >= num * (int(n[x] + n[i]) - shared):
                        joined.link(i, x)
    return joined.links


def _closed(members: DataFrame, content: DataFrame, work, tile: int, num: int, den: int) -> DataFrame:
    """Links within the families. ``members``: _id, k1, k2, n, fam; ``content``: _id, k1, k2, items. Gives node, component."""
    sizes = members.groupBy("fam").agg((F.count("*") > tile).alias("large"))
    banded = members.join(sizes, "fam").withColumn("band", F.when(F.col("large"), band("n", num, den)).otherwise(0))
    units = banded.groupBy("fam", "band").agg(F.ceil(F.count("*") / tile).alias("units"))

    def links(chosen: DataFrame) -> DataFrame:
        rows = _dealt(chosen, tile).join(content, ["_id", "k1", "k2"]).select(F.explode("tiles").alias("tile"), "_id", "pivot", "comp", "n", "items")
        return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(work), _FOUND)

    pivots = banded.join(units, ["fam", "band"]).withColumn("pivot", F.pmod(F.xxhash64("k2", "_id"), "units") == 0).withColumn("comp", F.col("_id"))
    found = stage_table(links(pivots), "links")
    joined = components(found)
    # what the pivots have not joined: all outside the largest component of a large family meets the others of the family
    comp = banded.where("large").join(joined.withColumnRenamed("node", "_id"), "_id", "left").withColumn("comp", F.coalesce("component", "_id"))
    size = comp.groupBy("fam", "comp").agg(F.count("*").alias("rows"))
    main = size.groupBy("fam").agg(F.max(F.struct("rows", "comp")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("fam", F.col("m.comp").alias("main"))
    apart = stage_table(comp.join(main, "fam").withColumn("pivot", F.col("comp") != F.col("main")).select("_id", "k1", "k2", "n", "fam", "band", "pivot", "comp"), "apart")
    return joined if apart.isEmpty() else components(found.unionByName(links(apart)))


_SET = T.StructType().add("_id", "long").add("k1", "long").add("k2", "long").add("items", "binary")


def _sets(batches):
    for batch in batches:
        for a, b, raw, off in slices(batch.column(1)):
            sets = shingle_sets(raw, off)
            one, two = _keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(one), pa.array(two), pa.array([s.tobytes() for s in sets], pa.binary())], names=_SET.names)


def link_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, tile: int = TILE, run_pairs: int = RUN_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; linked where the Jaccard similarity is num / den or more."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    measured = stage_table(rows.mapInArrow(_measure(), "_id long, n long, k1 long, k2 long, chunk int, bits binary"), "sets")
    levels = spark.sparkContext.broadcast(_levels(measured))
    every = measured.where("chunk is null").drop("chunk")
    classes = every.where("n > 0 and _id is not null").groupBy("k1", "k2").agg(F.min("_id").alias("_id"))

    starts = rows.where("_id is not null").mapInArrow(_prefixes(levels, num, den), "_id long, n int, k1 long, k2 long, start array<long>")
    tokens = starts.join(classes, ["_id", "k1", "k2"], "left_semi").select(F.explode("start").alias("token"), "_id", "n")
    pairs = _candidates(tokens, num, den, run_pairs)

    stand = every.join(classes, ["_id", "k1", "k2"], "left_semi").groupBy("_id", "k1", "k2", "n").agg(F.first("bits").alias("items"))
    members = stage_table(stand.join(_families(components(pairs)), "_id"), "members")
    bound = lambda *x: bound_tile(*x, num, den)
    exact = lambda *x: join_tile(*x, num, den)
    finer = _closed(members.drop("items"), members.select("_id", "k1", "k2", "items"), bound, tile, num, den)
    members = stage_table(members.drop("fam", "items").join(_families(finer), "_id"), "members")
    wanted = members.select("_id").distinct()
    content = sifted(rows, wanted, ["_id"]).join(wanted.hint("merge"), "_id").select("_id", "_text").mapInArrow(_sets, _SET)
    content = stage_table(content.join(members.select("_id", "k1", "k2"), ["_id", "k1", "k2"], "left_semi"), "contents")
    joined = _closed(members, content, exact, tile, num, den)

    least = classes.join(joined.withColumnRenamed("node", "_id"), "_id", "left").select("k1", "k2", F.coalesce("component", "_id").alias("least"))
    out = every.join(least.groupBy("k1", "k2").agg(F.min("least").alias("least")), ["k1", "k2"], "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNull(), None).when(F.col("n") == 0, F.col("_id")).otherwise(F.col("least")).alias("component_id"))


def _families(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("_id"), F.col("component").alias("fam"))
