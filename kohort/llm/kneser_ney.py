"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, against language quantiles.

The model is over code points, orders 1 to 4, in whatever script: every letter and sign is a symbol of its own; only the digits 0
to 9 are all read as 0, as which number it is says nothing about quality. Counts come from all trusted documents: tasks count
n-grams, Spark adds them up. The highest order uses counts, lower ones the number of different symbols seen before (continuation
counts); below all orders every code point is as likely as any other. Each order's counts are joined with the totals of their
contexts, which gives discounted shares and the weight left to the order below. Both stay tables, sharded by context; they grow with
the trusted texts and are never gathered. To score, documents are packed (compressed, about 1 MB of text a pack) and dealt to blocks
of about 16 MB; a task finds the distinct n-grams of its block, these meet the model's shares and weights in joins on the context,
and their costs go back to the block, where each document adds up its own. So texts are shuffled once, and of n-grams only the
distinct ones of a block.

Short texts say little, so a text's perplexity is that of the text after ``prior`` symbols at the average cost of trusted text.
A document is kept if it is at most the ``quantile`` of the trusted documents of its language (of all languages where fewer
than ``least`` are trusted). A model costs the texts it was fitted on too little, so for the quantiles every trusted text is
scored by the model of the other half (dealt by a hash of the text, so that copies stay together); where a half is empty, the
whole model scores it. Quantiles are exact to 0.1%, from counts of perplexity bins; one standard error of the quantile is
added, as few trusted texts say little about it. It goes with one over the root of their number.

Null and empty texts have no perplexity and are kept. A null language is a language of its own. A null id is scored but never
trusted. Repeated rows are scored alike; repeated labels must agree that a document is good. With no trusted text at all,
every document is kept. Existing columns with the names of new ones are replaced.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kohort.llm.arrow_text import release, slices, small_batches, unused
from kohort.llm.sieve import sifted
from kohort.session import shuffles_dropped, stage_table

ORDER = 4
BITS = 21  # of a code point
SYMBOLS = 1 << BITS
BINS = 1000
#: Bytes of text in a pack, and in a block, whose distinct n-grams are looked up together.
PACK, BLOCK = 1 << 20, 1 << 24
#: Of the compression of packs, which are all that is shuffled of the texts: 17% smaller than at level 1.
LEVEL = 6
#: N-grams found in the slices of a block that are held before their repeats are dropped.
HELD = 1 << 19
NEW = ("n_symbols", "perplexity", "threshold", "keep")
WHOLE = 2  # the model of both halves; 0 and 1 are those of one
_SPACE, _ZERO = 32, 48


class Model(NamedTuple):
    """(model, order, context, symbol, share), (model, order, context, left), and the mean cost of its own text by model."""

    shares: DataFrame
    lefts: DataFrame
    means: dict[int, float]


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes (digits as 0), and the offsets of rows among them. What is no UTF-8 gives the bits that are there."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    bounds = np.concatenate(([0], np.cumsum(lead)))[off]
    out = raw[at].astype(np.int64)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        start, first = at[wide], out[wide]
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        end = np.minimum(np.append(at, len(raw))[wide + 1], off[np.searchsorted(off, start, side="right")])
        value = first & (0x3F >> more)
        for k in (1, 2, 3):
            here = (k <= more) & (start + k < end)
            value = np.where(here, value << 6 | raw[np.minimum(start + k, len(raw) - 1)] & 0x3F, value)
        out[wide] = value
    out[(out > _ZERO) & (out <= _ZERO + 9)] = _ZERO
    return out, bounds


def ngrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol the ``ORDER`` - 1 before it (the nearest in the lowest bits; spaces before the text), itself, and row offsets."""
    sym, bounds = symbols(raw, off)
    context = np.zeros_like(sym)
    before = sym
    for k in range(1, ORDER):
        before = np.concatenate(([_SPACE], before[:-1])) if len(sym) else before
        before[bounds[:-1][np.diff(bounds) > 0]] = _SPACE
        context |= before << (BITS * (k - 1))
    return context, sym, bounds


class Numbering:
    """A number for every n-gram of the given contexts' and symbols' code points, whatever their script; ``back`` undoes it."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray):
        self.rank = np.zeros(SYMBOLS, dtype=np.int64)
        self.rank[symbol] = 1
        for k in range(ORDER - 1):
            self.rank[(context >> (BITS * k)) & (SYMBOLS - 1)] = 1
        self.alphabet = np.flatnonzero(self.rank)
        self.size = len(self.alphabet)
        self.rank[self.alphabet] = np.arange(self.size)
        # so many code points that four do not fit 63 bits: contexts are numbered instead
        self.contexts = None if self.size**ORDER < 1 << 63 else np.unique(context)

    def of(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.contexts is not None:
            return np.searchsorted(self.contexts, context) * self.size + self.rank[symbol]
        out = self.rank[symbol]
        for k in range(ORDER - 1):
            out += self.rank[(context >> (BITS * k)) & (SYMBOLS - 1)] * self.size ** (k + 1)
        return out

    def back(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = self.alphabet[number % self.size]
        if self.contexts is not None:
            return self.contexts[number // self.size], symbol
        context = np.zeros_like(number)
        for k in range(ORDER - 1):
            context |= self.alphabet[number // self.size ** (k + 1) % self.size] << (BITS * k)
        return context, symbol


def distinct_ngrams(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams and how often each occurs."""
    numbering = Numbering(context, symbol)
    number, n = np.unique(numbering.of(context, symbol), return_counts=True)
    return *numbering.back(number), n


def _count(batches):
    for batch in batches:
        half = batch.column(1).to_numpy()
        for a, b, raw, off in slices(batch.column(0)):
            context, symbol, bounds = ngrams(raw, off)
            which = np.repeat(half[a:b], np.diff(bounds))
            for h in (0, 1):
                c, s, n = distinct_ngrams(context[which == h], symbol[which == h])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), h), pa.int32()), pa.array(c), pa.array(s, pa.int32()), pa.array(n)], names=["half", "context", "symbol", "c"])


def union_ngrams(parts) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of all ``parts`` (contexts, symbols); never many more are held than there are different ones."""
    held, size, least = [], 0, HELD
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= least:
            held = [distinct_ngrams(*[np.concatenate(x) for x in zip(*held)])[:2]]
            size = len(held[0][0])
            least = max(HELD, 2 * size)
    return distinct_ngrams(*[np.concatenate(x) for x in zip(*held)])[:2]


def half_of(text: Column) -> Column:
    """0 or 1 by a hash of the text."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(half, context, symbol, c) of the highest order; ``texts`` has one column."""
    text = F.col(f"`{texts.columns[0]}`").cast("string")
    found = texts.select(text, half_of(text).alias("half")).mapInArrow(_count, "half int, context long, symbol int, c long")
    return stage_table(found.groupBy("half", "context", "symbol").agg(F.sum("c").alias("c")), "ngrams")


def fit(counts: DataFrame) -> Model | None:
    """The models of both halves and of all text, from what ``ngram_counts`` gives; None if there is no text."""
    spark = counts.sparkSession
    both = counts.withColumn("model", F.explode(F.array("half", F.lit(WHOLE)))).groupBy("model", "context", "symbol").agg(F.sum("c").alias("c"))
    tables = {ORDER: stage_table(both, "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("context")
        tables[k] = stage_table(tables[k + 1].groupBy("model", shorter, "symbol").agg(F.count("*").alias("c")), "ngrams")
    rows = reduce(DataFrame.unionByName, [t.withColumn("order", F.lit(k)) for k, t in tables.items()])
    seen = {(r.model, r.order): r for r in rows.groupBy("model", "order").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    if not seen:
        return None
    cuts = [(m, k, *discounts(r.n1, r.n2, r.n3, r.n4)) for (m, k), r in seen.items()]
    cuts = spark.createDataFrame(cuts, "model int, order int, d1 double, d2 double, d3 double")  # three models of four orders
    rows = rows.join(F.broadcast(cuts), ["model", "order"])
    rows = rows.withColumn("cut", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    keys = ["model", "order", "context"]
    totals = rows.groupBy(*keys).agg(F.sum("c").alias("total"), F.sum("cut").alias("cut"))
    lefts = stage_table(totals.select(*keys, (F.col("cut") / F.col("total")).alias("left")), "ngram-lefts")
    shares = rows.join(totals.select(*keys, "total"), keys).select(*keys, "symbol", ((F.col("c") - F.col("cut")) / F.col("total")).alias("share"))
    shares = stage_table(shares, "ngram-shares")
    own = ngram_costs(tables[ORDER], Model(shares, lefts, {}), "c")
    with shuffles_dropped(spark):
        means = own.groupBy("model").agg((F.sum(F.col("cost") * F.col("c")) / F.sum("c")).alias("mean")).collect()
    return Model(shares, lefts, {r.model: r.mean for r in means})


def ngram_costs(grams: DataFrame, model: Model, carry: str) -> DataFrame:
    """(model, context, symbol, ``carry``, cost: -ln p of the symbol after the context); ``grams`` are distinct."""
    masks = F.array(*[F.lit((1 << BITS * (k - 1)) - 1).cast("long") for k in range(1, ORDER + 1)])
    each = grams.select("model", F.col("context").alias("whole"), "symbol", F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("order"), F.col(carry).alias("_c"))
    each = each.withColumn("context", F.col("whole").bitwiseAND(F.element_at(masks, F.col("order")))).withColumn(carry, F.when(F.col("order") == ORDER, F.col("_c"))).drop("_c")
    keys = ["model", "order", "context"]
    met = each.join(model.lefts, keys, "left").join(model.shares, [*keys, "symbol"], "left")
    by_order = [F.max(F.when(F.col("order") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, ORDER + 1) for c in ("share", "left")]
    wide = met.groupBy("model", "whole", "symbol").agg(F.first(carry, ignorenulls=True).alias(carry), *by_order)
    p = F.lit(1.0 / SYMBOLS)
    for k in range(1, ORDER + 1):
        p = F.coalesce(f"share{k}", F.lit(0.0)) + F.coalesce(f"left{k}", F.lit(1.0)) * p
    return wide.select("model", F.col("whole").alias("context"), "symbol", carry, (-F.ln(p)).alias("cost"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of the modified method; plain ones where the counts of counts do not give them."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def costs(texts: DataFrame) -> Model | None:
    """The model of one column of texts; None if there is no text."""
    return fit(ngram_counts(texts))


def perplexities(docs: DataFrame, model: Model, prior: int, text: str = "text", which: Column | None = None) -> DataFrame:
    """``docs`` with n_symbols and perplexity. ``which`` says by which model a row is scored: 0, 1 or ``WHOLE`` (all rows, if not given)."""
    keep = [c for c in docs.columns if c not in NEW]
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    body = text if text in keep and kinds[text] == "string" else unused("_text", keep)
    extra = [] if body == text else [F.col(f"`{text}`").cast("string").alias(body)]
    # the model's number is the last column
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *extra, (F.lit(WHOLE) if which is None else which).cast("int").alias(unused("_model", [*keep, body])))
    size = source.agg(F.sum(F.octet_length(F.col(f"`{body}`").cast("binary")))).first()[0] or 0
    blocks = max(-(-size // BLOCK), min(spark.sparkContext.defaultParallelism, -(-size // PACK)), 1)
    at, means = source.columns.index(body), model.means

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy()
            for m in np.unique(number):
                mine = batch.filter(pa.array(number == m))
                for a, b, _, _ in slices(mine.column(at), PACK):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, mine.schema, options=options) as out:
                        out.write_batch(mine.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["model", "pack"])

    def opened(packs):
        for payload in packs:
            yield pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()

    def find(table):
        parts = (ngrams(raw, off)[:2] for rows in opened(table.column("pack")) for _, _, raw, off in slices(rows.column(at)))
        context, symbol = union_ngrams(distinct_ngrams(*part)[:2] for part in parts)
        release()
        ids = [pa.array(np.full(len(symbol), table.column(c)[0].as_py()), pa.int32()) for c in ("model", "block")]
        return pa.table([*ids, pa.array(context), pa.array(symbol, pa.int32())], names=["model", "block", "context", "symbol"])

    def score(prices, table):
        context, symbol = (prices.column(c).to_numpy().astype(np.int64) for c in ("context", "symbol"))
        numbering = Numbering(context, symbol)
        number = numbering.of(context, symbol)
        order = np.argsort(number)
        number, cost = number[order], prices.column("cost").to_numpy()[order]
        done = []
        for rows in opened(table.column("pack")):
            mean = means[rows.column(rows.num_columns - 1)[0].as_py()]
            for a, b, raw, off in slices(rows.column(at)):
                c, s, bounds = ngrams(raw, off)
                n, total = np.diff(bounds), np.zeros(b - a)
                full = n > 0
                if full.any():
                    wanted = numbering.of(c, s)
                    place = np.minimum(np.searchsorted(number, wanted), len(number) - 1)
                    if not np.array_equal(number[place], wanted):
                        raise RuntimeError("n-grams of a block came back without their costs")
                    total[full] = np.add.reduceat(cost[place], bounds[:-1][full])
                value = np.exp((total + prior * mean) / np.maximum(n + prior, 1))
                mine = rows.slice(a, b - a).select(range(len(keep)))
                done.append(pa.Table.from_arrays([*mine.columns, pa.array(n.astype(np.int64)), pa.array(value, mask=~full)], names=[*keep, "n_symbols", "perplexity"]))
        release()
        return pa.concat_tables(done)

    block = F.pmod(F.xxhash64("pack"), F.lit(blocks)).cast("int").alias("block")
    # both uses below read the same shuffle of the packs; more partitions than blocks, so that few get several
    packs = source.mapInArrow(pack, "model int, pack binary").select("model", block, "pack").repartition(4 * blocks, "model", "block")
    found = packs.groupBy("model", "block").applyInArrow(find, "model int, block int, context long, symbol int")
    grams = found.groupBy("model", "context", "symbol").agg(F.collect_list("block").alias("blocks"))
    prices = ngram_costs(grams, model, "blocks").select("model", F.explode("blocks").alias("block"), "context", "symbol", "cost")
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("n_symbols", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return prices.groupBy("model", "block").cogroup(packs.groupBy("model", "block")).applyInArrow(score, schema)


def trusted_ids(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids whose labels all say good quality and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_trusted")).agg(F.min(good).alias("good")).where("good").select("_trusted")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, least: int = 30, prior: int = 512, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with n_symbols, perplexity, threshold and keep."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in NEW]
    trusted = trusted_ids(labels)
    # a fixed-size filter first, so that little more than the trusted texts is shuffled
    theirs = docs.select(F.col(f"`{id_column}`").alias("_trusted"), F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").cast("string").alias("_text"))
    theirs = sifted(theirs, trusted, ["_trusted"]).join(trusted.hint("merge"), "_trusted", "left_semi").select("_lang", "_text")
    theirs = stage_table(theirs, "trusted", compression="zstd")
    model = costs(theirs.select("_text"))
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"n_symbols": F.lit(None).cast("long"), "perplexity": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "keep": F.lit(True)})
    other = 1 - half_of(F.col("_text"))
    unseen = F.when(other.isin([m for m in model.means if m != WHOLE]), other).otherwise(WHOLE)
    scored = perplexities(theirs, model, prior, "_text", unseen).where("perplexity is not null")
    bins = stage_table(scored.groupBy("_lang", F.floor(F.log("perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n")), "perplexity-bins")
    named = bins.select("_lang", F.lit(False).alias("all"), "bin", "n").unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("_lang"), F.lit(True).alias("all"), "bin", "n"))
    upto, whole = Window.partitionBy("all", "_lang").orderBy("bin"), Window.partitionBy("all", "_lang")
    ranked = named.withColumn("upto", F.sum("n").over(upto)).withColumn("of", F.sum("n").over(whole))
    reached = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("of") * q), F.col("bin"))).over(whole)
    ranked = ranked.withColumn("limit", reached(quantile)).withColumn("tail", reached(1 - 10 * (1 - quantile)))
    over = F.when(F.col("bin") > F.col("tail"), F.col("n"))
    limits = ranked.groupBy("all", "_lang", "limit", "of").agg(F.coalesce(F.sum(over * (F.col("bin") - F.col("tail"))) / F.sum(over), F.lit(0.0)).alias("excess"))
    error = F.col("excess") * F.sqrt(quantile / ((1 - quantile) * F.col("of")))  # of the quantile of an exponential tail
    limits = stage_table(limits.withColumn("threshold", F.exp((F.col("limit") + 1 + error) / float(BINS))), "thresholds")
    general = limits.where("all").select("threshold").first()
    general = general.threshold if general else float("inf")
    tag = unused("_l", docs.columns)
    own = limits.where((~F.col("all")) & (F.col("of") >= least)).select(F.col("_lang").alias(tag), "threshold")
    out = perplexities(docs.select(*[F.col(f"`{c}`") for c in keep]), model, prior, text)
    out = out.join(own, F.col(f"`{lang}`").cast("string").eqNullSafe(F.col(tag)), "left").drop(tag)
    limit = F.coalesce("threshold", F.lit(general))
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_symbols", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("keep"))
