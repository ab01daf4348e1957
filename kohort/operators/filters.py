"""Row filters and per-row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions.scalars import is_numeric, parse_date, row_sum

COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


class BadRequest(ValueError):
    """A filter request that cannot be served; the message is safe to show."""


def known(cond: Column) -> Column:
    """The condition with unknown taken as false."""
    return F.coalesce(cond, F.lit(False))


def missing_share(cols: list[str] | None = None) -> Column:
    cols = cols or fv.REQUIRED
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols]) / F.lit(float(len(cols)))


def drop_blank_rows(df: DataFrame, max_missing: float = 0.5, cols: list[str] | None = None) -> DataFrame:
    return df.filter(missing_share(cols) <= max_missing)


def implausible_birth(latest_year, rules: dict = fv.RULES) -> Column:
    limit = (latest_year if isinstance(latest_year, Column) else F.lit(latest_year)) - rules["min_customer_age"]
    return known((F.col("Year_Birth") < rules["min_birth_year"]) | (F.col("Year_Birth") > limit))


def latest_enrolment_year(df: DataFrame, default_year: int) -> int:
    row = df.agg(F.max(F.year(fv.ENROLLED)).alias("y")).first()
    return row["y"] if row["y"] is not None else default_year


def drop_implausible_birth(df: DataFrame, as_of_year: int) -> DataFrame:
    """Born before 1920 or too young in the year of the latest enrolment; a missing year stays."""
    return df.filter(~implausible_birth(latest_enrolment_year(df, as_of_year)))


def extreme_income(limit: float = fv.RULES["max_income"]) -> Column:
    return known(F.col("Income") > limit)


def drop_extreme_income(df: DataFrame) -> DataFrame:
    return df.filter(~extreme_income())


def spend_without_purchase() -> Column:
    return (row_sum([F.col(c) for c in fv.SPEND]) > 0) & (row_sum([F.col(c) for c in fv.CHANNELS]) == 0)


def drop_spend_without_purchase(df: DataFrame) -> DataFrame:
    return df.filter(~spend_without_purchase())


def segment_in(df: DataFrame, wanted: list[int], ids: list[int]) -> DataFrame:
    unknown = [s for s in wanted if s not in ids]
    if unknown:
        raise BadRequest(fv.ERROR_SEGMENTS.format(unknown))
    return df.filter(F.col("Segment").isin(sorted(set(wanted)))) if wanted else df


def comparison(df: DataFrame, field: str, op: str, value) -> Column:
    """One condition. Numeric fields take all operators, text only equality; a missing number passes ``!=`` only."""
    kinds = dict(df.dtypes)
    if field not in kinds:
        raise BadRequest(fv.ERROR_FIELD.format(field))
    if op not in COMPARE and op != "!=":
        raise BadRequest(fv.ERROR_OPERATOR.format(op))
    if is_numeric(kinds[field]):
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise BadRequest(fv.ERROR_NUMBER.format(field)) from None
        if field in fv.RATIO_FIELDS and number > 1:
            number /= 100
        if op == "!=":
            return F.coalesce(F.col(field) != number, F.lit(True))
        return known(COMPARE[op](F.col(field), F.lit(number)))
    if op not in ("==", "!="):
        raise BadRequest(fv.ERROR_TEXT.format(field))
    same = known(F.lower(F.col(field).cast("string")) == str(value).lower())
    return same if op == "==" else ~same


def filter_customers(df: DataFrame, segments: list[int], conditions: list[dict], ids: list[int]) -> DataFrame:
    """Conjunction of segment and field conditions in the fixed export order."""
    out = segment_in(df, segments, ids)
    for c in conditions:
        out = out.filter(comparison(df, c["feature"], c["op"], c["value"]))
    first = ["Segment", "Segment_Name", fv.ID, *fv.NUMERIC, "Education", "Marital_Status", fv.ENROLLED]
    order = first + [c for c in [*fv.DESCRIBING, *fv.DESCRIBING_LABELS] if c not in first]
    cols = [F.date_format(c, "yyyy-MM-dd").alias(c) if c == fv.ENROLLED else F.col(c) for c in order if c in df.columns]
    return out.select(*cols)


def record_warnings() -> Column:
    """Array of warnings about one customer record."""
    purchases = row_sum([F.col(c) for c in fv.CHANNELS])
    return F.array_compact(
        F.array(
            F.when(spend_without_purchase(), fv.WARN_SPEND),
            F.when(F.col("NumDealsPurchases") > purchases, fv.WARN_DEALS),
            F.when(F.col("Income").isNull(), fv.WARN_INCOME),
        )
    )


def bounds_check(df: DataFrame, bounds: dict | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Adds the array of columns whose value is outside its inclusive bounds; unknown columns are an error."""
    bounds = bounds or fv.RECORD_BOUNDS
    if allowed is not None:
        extra = [c for c in df.columns if c not in allowed]
        if extra:
            raise BadRequest(f"Unknown columns: {extra}")
    broken = [
        F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c)) for c, (lo, hi) in bounds.items() if c in df.columns
    ]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def record_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations``: the fields of the 26 of a customer record whose value a record may not hold, in the record's order.

    Numbers have inclusive bounds, flags are 0 or 1, labels come from their lists, and the enrolment date can be read as one. An
    empty income, flag or label is fine, as it has a default; any other empty field is a violation, and so is one whose column is
    missing. NaN is out of bounds. Other columns pass through.
    """
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).cast("double") if kinds[c] != "string" else F.col(c).try_cast("double")
    fine = {c: number(c).between(lo, hi) for c, (lo, hi) in fv.RECORD_BOUNDS.items() if c in kinds}
    fine |= {c: number(c).isin(0.0, 1.0) for c in fv.FLAGS if c in kinds}
    fine |= {c: F.col(c).isin(*labels) for c, labels in fv.RECORD_LABELS.items() if c in kinds}
    if fv.ENROLLED in kinds:
        fine[fv.ENROLLED] = parse_date(F.col(fv.ENROLLED), kinds[fv.ENROLLED]).isNotNull()
    broken = []
    for c in [*fv.RECORD_BOUNDS, *fv.FLAGS, *fv.RECORD_LABELS, fv.ENROLLED]:
        if c in fine:
            ok = F.coalesce(fine[c], F.lit(False))
            broken.append(F.when(~(ok | F.col(c).isNull() if c in fv.RECORD_MAY_BE_EMPTY else ok), F.lit(c)))
        elif c not in kinds and c not in fv.RECORD_MAY_BE_EMPTY:
            broken.append(F.lit(c))
    return df.withColumn("violations", F.array_compact(F.array(*broken)))
