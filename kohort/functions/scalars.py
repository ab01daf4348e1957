"""Scalar cleaning and feature expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kohort import fixed_values as fv

# what is beyond DOUBLE casts to an infinity, which counts as missing
_PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(dtype: str) -> bool:
    return dtype in _NUMERIC_TYPES or dtype.startswith("decimal")


def finite(c: Column) -> Column:
    """DOUBLE with NaN and infinities turned into NULL, the only missing marker used here."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def _parse_number(c: Column, junk: str) -> Column:
    # the extract is empty when the text is no number, and an empty string casts to NULL
    text = F.regexp_extract(F.regexp_replace(c.cast("string"), junk, ""), _PLAIN_NUMBER, 0)
    return finite(text.try_cast("double"))


def to_number(c: Column, dtype: str = "string") -> Column:
    """Number from text such as ``$58,138`` or ``58138 USD``; NULL when unreadable."""
    return finite(c) if is_numeric(dtype) else _parse_number(c, fv.NUMBER_JUNK)


def to_number_any(c: Column, dtype: str = "string") -> Column:
    """Any-table variant: also strips percent signs, leaves currency codes alone, booleans become 0/1."""
    if is_numeric(dtype) or dtype == "boolean":
        return finite(c.cast("double"))
    return _parse_number(c, fv.NUMBER_JUNK_ANY_TABLE)


def literal_map(table: dict) -> Column:
    """A MAP literal; meant for the fixed lookup tables, which have at most a few dozen entries."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def to_flag(c: Column, dtype: str = "string") -> Column:
    """0/1 from numbers or yes/no words; anything else is NULL."""
    number = lookup({0.0: 0.0, 1.0: 1.0}, to_number(c, dtype))
    if is_numeric(dtype):
        return number
    return F.coalesce(lookup(fv.FLAG_WORDS, F.lower(F.trim(c.cast("string")))), number)


def parse_date(c: Column, dtype: str = "string", iso_first: bool = False) -> Column:
    """DATE from mixed layouts, day before month; impossible dates are NULL."""
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("date")
    text = F.trim(c.cast("string"))
    layouts = list(fv.DATE_LAYOUTS)
    if iso_first:
        layouts.sort(key=lambda f: f != "yyyy-M-d")
    tries = [F.try_to_date(text, f) for f in layouts]
    with_time = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]"), text.try_cast("timestamp_ntz").cast("date"))
    # a clock time behind any layout plays no part
    day = F.regexp_replace(text, r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([aApP][mM])?$", "")
    more = [F.when(day.rlike(shape), F.try_to_date(day, f)) for shape, f in fv.DATE_SHAPES]
    short = F.when(day.rlike(fv.SHORT_DATE), F.regexp_replace(day, "[.-]", "/"))
    short = F.coalesce(*[F.try_to_date(short, f) for f in ("d/M/yy", "M/d/yy")])
    short = F.when(F.year(short) > fv.LAST_SHORT_YEAR, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(*tries, with_time, *more, short)


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def name_key(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789")


def canonical_label(c: Column, labels, synonyms: dict[str, str]) -> Column:
    """Canonical label for case, spacing, punctuation and synonym variants; NULL when unknown."""
    return lookup({**synonyms, **{name_key(l): l for l in labels}}, label_key(c))


def canonical_education(c: Column) -> Column:
    return canonical_label(c, fv.EDUCATION_GROUPS, fv.EDUCATION_SYNONYMS)


def canonical_marital(c: Column) -> Column:
    return canonical_label(c, fv.MARITAL_GROUPS, fv.MARITAL_SYNONYMS)


def group_label(c: Column, groups: dict[str, str]) -> Column:
    return F.coalesce(lookup(groups, c), F.lit("Unknown"))


def null_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def clear_future(d: Column, as_of) -> Column:
    return F.when(d <= F.lit(as_of).cast("date"), d)


def safe_ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def row_sum(cols: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def clip(c: Column, lo, hi) -> Column:
    """Bounded value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    return F.when(c.isNotNull(), out)


def cap_at(c: Column, limit: Column) -> Column:
    return F.when(c.isNotNull() & limit.isNotNull(), F.least(c, limit))


def log1p_floor(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def age_band(age: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(fv.AGE_EDGES, fv.AGE_EDGES[1:], fv.AGE_LABELS))):
        out = F.when((age > lo) & (age <= hi), F.lit(label)).otherwise(out)
    return out


def tenure_days(enrolled: Column, reference) -> Column:
    ref = F.lit(reference).cast("date")
    return F.greatest(F.date_diff(ref, F.coalesce(enrolled.cast("date"), ref)), F.lit(0))


def pretty(c: Column) -> Column:
    """Display form of a column name held in a string column."""
    spaced = F.regexp_replace(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " "), "_", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """Lower-case words and digit runs of a camelCase / snake_case name."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+)"), F.lit(1))
    return F.transform(found, F.lower)


def format_value(c: Column) -> Column:
    return (
        F.when(c.isNull() | F.isnan(c.cast("double")), F.lit("–"))
        .when(F.abs(c) >= 1000, F.format_number(c, 0))
        .when(F.abs(c) >= 10, F.format_number(c, 1))
        .otherwise(F.format_string("%.2f", c.cast("double")))
    )


def days_before(d: Column, latest) -> Column:
    return F.date_diff(F.lit(latest).cast("date"), d.cast("date")).cast("double")


def category_with_other(c: Column, levels: list[str]) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.isNull(), "Missing").when(text.isin(*levels), text).otherwise("Other")


def sanitized(c: Column) -> Column:
    """Text cell made safe for spreadsheets: a leading formula character gets a quote in front."""
    return F.when(c.rlike(fv.FORMULA_STARTS), F.concat(F.lit("'"), c)).otherwise(c)
