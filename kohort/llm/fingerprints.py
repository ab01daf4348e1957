"""Document fingerprints that add up: a homomorphic hash of a text's paragraphs, with DataFrame functions only.

A paragraph is what stands between line feeds, if it is not empty. Its wide vector of whole numbers has

* ``EQUAL`` lanes modulo 2**32, the 32-bit words of two SHA-256 hashes of the paragraph;
* ``ALIKE`` lanes modulo 2**24: for every ``GROUP`` words of the paragraph, counted from its start, the bits of their MD5;
* two counters modulo 2**32: paragraphs and groups of words.

A text's fingerprint is the sum of its paragraphs' vectors, lane by lane and modulo those powers, so it does not depend on
the order of paragraphs, and ``plus`` and ``minus`` insert or delete paragraphs without the text. Equal multisets of
paragraphs have equal fingerprints; others collide with negligible chance. A lane of bits, taken as signs, is a random
projection of the counts of the groups, so the lanes of two fingerprints estimate the scalar product of their counts:
``likeness`` is 2ab / (aa + bb), cut to 0..1, with a standard error of about 1 / sqrt(ALIKE); equal fingerprints give 1.

A null or empty text has the fingerprint of nothing (all lanes 0), and texts of white space count paragraphs only. Texts
may be of any length below 2**31 groups; a hash aggregate adds up the lanes in the task that holds the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kohort.session import stage_table

EQUAL, ALIKE, GROUP = 16, 128, 4
_WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a paragraph in groups.
GROUPS = f"{_WORD}(?:[\\x20\\x09-\\x0D]+{_WORD}){{0,{GROUP - 1}}}"
_HALF = 32
#: Bits of each lane, in the order of the fingerprint: counters, lanes of equality, lanes of likeness.
WIDTHS = [32, 32] + [32] * EQUAL + [24] * ALIKE
_SEQ = (1 << 33) - 1


def _words32(digest: Column, n: int) -> list[Column]:
    """The first ``n`` 32-bit words of a hash in hexadecimal digits."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def add_lanes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``lanes`` (array<bigint>, not yet reduced): the sums over all rows that share ``keys``."""
    paragraphs = texts.select(*keys, F.explode_outer(F.split(F.col(text), "\n")).alias("_p")).withColumn("_p", F.coalesce("_p", F.lit("")))
    equal = [w for head in "01" for w in _words32(F.sha2(F.concat(F.lit(head), F.col("_p")).cast("binary"), 256), EQUAL // 2)]
    named = paragraphs.select(*keys, "_p", *[F.when(F.col("_p") != "", w).otherwise(0).alias(f"_e{i}") for i, w in enumerate(equal)], F.regexp_extract_all("_p", F.lit(GROUPS), F.lit(0)).alias("_g"))
    groups = named.select(*keys, "_p", *[f"_e{i}" for i in range(EQUAL)], F.posexplode_outer("_g").alias("_i", "_x")).withColumn("_m", F.md5(F.col("_x").cast("binary")))
    words = groups.select(*keys, F.coalesce("_i", F.lit(0)).alias("_i"), (F.col("_p") != "").cast("long").alias("_has"), F.col("_x").isNotNull().cast("long").alias("_n"), *[f"_e{i}" for i in range(EQUAL)], *[F.coalesce(w, F.lit(0)).alias(f"_w{i}") for i, w in enumerate(_words32(F.col("_m"), ALIKE // 32))])
    first = F.col("_i") == 0
    sums = [F.sum(F.when(first, F.col("_has")).otherwise(0)).alias("_s0"), F.sum("_n").alias("_s1"), *[F.sum(F.when(first, F.col(f"_e{i}")).otherwise(0)).alias(f"_q{i}") for i in range(EQUAL)]]

    def bit(word: int, place: int) -> Column:
        return F.shiftright(F.col(f"_w{word}"), place).bitwiseAND(F.lit(1))

    # two lanes travel in one number, the second 32 bits higher
    pairs = [(word, place) for word in range(0, ALIKE // 32, 2) for place in range(32)]
    sums += [F.sum(bit(word, place) + F.shiftleft(bit(word + 1, place), _HALF)).alias(f"_b{word}_{place}") for word, place in pairs]
    added = words.groupBy(*keys).agg(*sums)
    low = F.lit((1 << _HALF) - 1)
    lanes = [F.col(f"_b{w - w % 2}_{p}").bitwiseAND(low) if w % 2 == 0 else F.shiftright(F.col(f"_b{w - 1}_{p}"), _HALF) for w in range(ALIKE // 32) for p in range(32)]
    return added.select(*keys, F.array(F.col("_s0"), F.col("_s1"), *[F.col(f"_q{i}") for i in range(EQUAL)], *lanes).alias("lanes"))


def _masks() -> Column:
    return F.array(*[F.lit((1 << w) - 1).cast("long") for w in WIDTHS])


def reduced(lanes: Column) -> Column:
    """Each lane modulo its power of two."""
    return F.zip_with(lanes, _masks(), lambda x, m: x.bitwiseAND(m))


def plus(a: Column, b: Column) -> Column:
    """Lanes of both multisets of paragraphs together."""
    return reduced(F.zip_with(a, b, lambda x, y: x + y))


def minus(a: Column, b: Column) -> Column:
    """Lanes of ``a`` without the paragraphs of ``b``."""
    return reduced(F.zip_with(a, b, lambda x, y: x - y))


def shown(lanes: Column) -> Column:
    """Lanes as lower-case hexadecimal digits, 8 or 6 to a lane."""
    wide, narrow = F.slice(lanes, 1, EQUAL + 2), F.slice(lanes, EQUAL + 3, ALIKE)
    digits = F.concat(F.array_join(F.transform(wide, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.array_join(F.transform(narrow, lambda x: F.lpad(F.hex(x), 6, "0")), ""))
    return F.lower(digits)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from the reduced lanes of two fingerprints; exact whole numbers up to the last division."""

    def signs(lanes: Column) -> Column:
        n = F.element_at(lanes, 2)
        return F.transform(F.slice(lanes, EQUAL + 3, ALIKE), lambda x: (2 * x - n).cast("double"))

    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = signs(a), signs(b)
    both = total(x, x) + total(y, y)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(both > 0, 2 * total(x, y) / both).otherwise(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``key`` (a hash of id and text), ``id`` and ``text``, never null but for the id."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    return rows.select(F.unhex(F.sha2(named.cast("binary"), 256)).alias("key"), "id", "text")


def _one(copies: str) -> Column:
    """Reduced lanes of one of several equal rows that were added up; every sum is a whole multiple of their number."""
    return reduced(F.transform("lanes", lambda x: F.call_function("div", x, F.col(copies))))


def _narrow(lanes: Column) -> Column:
    """Reduced lanes as array<int>, half the size to move; ``_wide`` is the way back."""
    top = F.lit(1 << 31)
    return F.transform(lanes, lambda x: (x.bitwiseXOR(top) - top).cast("int"))


def _wide(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: x.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``copies`` (rows), ``lanes`` and ``fingerprint`` of every distinct (id, text); other columns play no part."""
    rows = _keyed(docs, id_column, text)
    facts = rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("id").alias("id"))
    lanes = add_lanes(rows, ["key"], "text").join(facts, "key")
    return lanes.select(F.col("id").alias("doc_id"), "copies", _one("copies").alias("lanes")).withColumn("fingerprint", shown(F.col("lanes")))


def _in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows with their neighbour: key, id, n_chars, copies, prev_key (the one before, by falling id) and want, half of its length.

    Rows are ranged over the partitions and numbered there; only the sizes of the partitions are added up in one place.
    """
    classes = rows.groupBy("key").agg(F.first("id").alias("id"), F.max(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("copies"))
    order = [F.col("id").desc_nulls_last(), F.col("key").asc()]
    ordered = stage_table(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "fingerprint-order")
    ordered = ordered.withColumn("part", F.shiftright("seq", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    # a row for each partition
    ranked = ordered.join(F.broadcast(parts), "part").withColumn("pos", F.col("offset") + F.col("seq").bitwiseAND(F.lit(_SEQ)))
    previous = ranked.select(F.pmod(F.col("pos") + 1, "total").alias("pos"), F.col("key").alias("prev_key"), F.expr("n_chars div 2").alias("want"))
    return stage_table(ranked.join(previous, "pos").select("key", "id", "n_chars", "copies", "prev_key", "want"), "fingerprint-neighbours")


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the row's with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next row's. Rows follow each other by falling id, null ids last, rows of one id by a hash of their text; after the last
    comes the first, and of equal rows all but one are followed by their equal. The near columns are the ``likeness`` of the
    row's fingerprint to the edited text's and to the next row's. An empty table gives an empty one.
    """
    rows = _keyed(docs, id_column, text)
    links = _in_order(rows)
    # with all that later steps need of a row, so that its lanes move to its own key and to the row before, and no further
    own = add_lanes(rows, ["key"], "text").join(links.drop("want"), "key").select("key", "id", "n_chars", "prev_key", _narrow(_one("copies")).alias("lanes"))
    own = stage_table(own, "fingerprint-lanes")
    half = F.expr("length(text) div 2")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    # what each text gives to the rows before it: (to whom, how much, whether to its own copies, how many)
    gifts = F.array(F.struct(F.col("prev_key").alias("to"), F.col("want"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("times")))
    to_copies = F.array(F.struct(F.col("key").alias("to"), F.expr("n_chars div 2").alias("want"), F.lit(1).alias("kind"), (F.col("copies") - 1).alias("times")))
    given = texts.join(links.select("key", F.explode(F.when(F.col("copies") > 1, F.concat(gifts, to_copies)).otherwise(gifts)).alias("g")), "key")
    rests = given.select(F.col("g.to").alias("key"), "g.kind", "g.times", F.col("text").substr(F.lit(1), F.col("g.want").cast("int")).alias("rest"))
    edited = texts.join(rests, "key").select("key", "kind", "times", F.concat(F.col("text").substr(F.lit(1), (F.length("text") - half).cast("int")), "rest").alias("text"))
    edited = edited.select("key", "kind", "times", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"), "text")
    changed = add_lanes(edited, ["key", "kind", "times", "edited_sha256"], "text").withColumn("edited_lanes", reduced(F.col("lanes"))).drop("lanes")
    following = own.select(F.col("prev_key").alias("key"), F.col("lanes").alias("next_lanes"))
    out = own.drop("prev_key").join(changed, "key").join(following, "key")
    after = _wide(F.when(F.col("kind") == 1, F.col("lanes")).otherwise(F.col("next_lanes")))
    out = out.select("id", "n_chars", "edited_sha256", "edited_lanes", "times", _wide(F.col("lanes")).alias("lanes"), after.alias("after"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        shown(F.col("lanes")).alias("fingerprint"),
        shown(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("after")).alias("near_next"),
    )


def _sql() -> str:
    """The same in DuckDB SQL, for ids that are not repeated."""
    word = [f"CAST('0x' || substr(m, {8 * w + 1}, 8) AS BIGINT) AS w{w}" for w in range(ALIKE // 32)]
    equal = [f"sum(CAST('0x' || substr(sha256('{h}' || p), {8 * i + 1}, 8) AS BIGINT)) % 4294967296" for h in "01" for i in range(EQUAL // 2)]
    alike = [f"sum((w{w} >> {j}) & 1) % 16777216" for w in range(ALIKE // 32) for j in range(32)]
    whole = [f"CAST({x} AS BIGINT)" for x in ["count(*)", *equal]]
    signs = "list_transform(%s.alike, lambda x: CAST(2 * x - %s.n AS DOUBLE))"

    def near(a: str, b: str) -> str:
        x, y = signs % (a, a), signs % (b, b)
        dot = "list_sum(list_transform(list_zip(%s, %s), lambda z: z[1] * z[2]))"
        both = f"({dot % (x, x)} + {dot % (y, y)})"
        return f"CASE WHEN {a}.shown = {b}.shown THEN 1.0 WHEN {both} > 0 THEN greatest(0.0, least(1.0, 2 * {dot % (x, y)} / {both})) ELSE 0.0 END"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents),
    o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC)),
    e AS (SELECT *, left(t, n_chars - n_chars // 2) || left(nt, n_chars // 2) AS et FROM o),
    x AS (SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, et FROM e),
    p AS (SELECT doc_id, kind, p FROM (SELECT doc_id, kind, unnest(string_split(t, chr(10))) AS p FROM x) WHERE p <> ''),
    g AS (SELECT doc_id, kind, md5(unnest(regexp_extract_all(p, '{GROUPS}'))) AS m FROM p),
    k AS (SELECT doc_id, kind, {", ".join(word)} FROM g),
    a AS (SELECT doc_id, kind, count(*) AS n, [{", ".join(f"CAST({v} AS BIGINT)" for v in alike)}] AS alike FROM k GROUP BY doc_id, kind),
    q AS (SELECT doc_id, kind, [{", ".join(whole)}] AS equal FROM p GROUP BY doc_id, kind),
    f AS (SELECT x.doc_id, x.kind, coalesce(n, 0) AS n, coalesce(alike, list_transform(range({ALIKE}), lambda i: CAST(0 AS BIGINT))) AS alike,
        coalesce(equal, list_transform(range({EQUAL + 1}), lambda i: CAST(0 AS BIGINT))) AS equal FROM x LEFT JOIN a USING (doc_id, kind) LEFT JOIN q USING (doc_id, kind)),
    s AS (SELECT doc_id, kind, n, alike, printf('%08x', equal[1]) || printf('%08x', n) || list_aggregate(list_transform(equal[2:], lambda v: printf('%08x', v)), 'string_agg', '')
        || list_aggregate(list_transform(alike, lambda v: printf('%06x', v)), 'string_agg', '') AS shown FROM f)
    SELECT e.doc_id, e.n_chars, sha256(e.et) AS edited_sha256, u.shown AS fingerprint, v.shown AS edited_fingerprint, {near("u", "v")} AS near_edited, {near("u", "z")} AS near_next
    FROM e JOIN s u ON u.doc_id = e.doc_id AND u.kind = 0 JOIN s v ON v.doc_id = e.doc_id AND v.kind = 1 JOIN s z ON z.doc_id = e.next_id AND z.kind = 0"""


SQL = _sql()
