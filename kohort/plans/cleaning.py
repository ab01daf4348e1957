"""The whole cleaning policy with its audit.

Duplicates are folded by aggregation, and every fold carries how many rows it stands for. One small
aggregate over the folded table then yields all audit counts, instead of one job per step.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions import scalars as S
from kohort.operators.dedup import fill_missing_ids, own_group_when_null
from kohort.operators.filters import extreme_income, implausible_birth, known, missing_share, spend_without_purchase
from kohort.operators.impute import fitted_medians
from kohort.operators.quantiles import exact_quantiles
from kohort.operators.reshape import constant_columns
from kohort.session import spread, stage_table

AUDIT_SCHEMA = "position int, step string, rows_before long, rows_after long, rows_removed long, detail string"


@dataclass
class Cleaned:
    customers: DataFrame
    audit: DataFrame


def parsed(df: DataFrame) -> DataFrame:
    """Adds ``_v_…`` columns: numbers, flags and dates read from the raw columns, each parsed once."""
    kinds = dict(df.dtypes)
    values = {f"_v_{c}": (S.to_flag if c in fv.FLAGS else S.to_number)(F.col(c), kinds[c]) for c in fv.NUMERIC}
    values[f"_v_{fv.ENROLLED}"] = S.parse_date(F.col(fv.ENROLLED), kinds[fv.ENROLLED])
    return df.withColumns(values)


def standardise(df: DataFrame) -> DataFrame:
    """Typed columns, negative amounts missing, and three counters per row: text values read as numbers, values
    cleared, and the share of required fields missing."""
    kinds = dict(df.dtypes)
    total = lambda conditions: sum([known(c).cast("int") for c in conditions], F.lit(0))
    value = lambda c: F.col(f"_v_{c}")
    texts = [c for c in fv.NUMERIC if not S.is_numeric(kinds[c])]
    converted = total([value(c).isNotNull() & F.trim(F.col(c).cast("string")).try_cast("double").isNull() for c in texts])
    cleared = total([F.col(c).isNotNull() & value(c).isNull() for c in fv.NUMERIC] + [value(c) < 0 for c in fv.NUMERIC])
    rest = [c for c in df.columns if c not in fv.NUMERIC and c != fv.ENROLLED]
    typed = parsed(df).select(
        *rest,
        *[S.null_negative(value(c)).alias(c) for c in fv.NUMERIC],
        value(fv.ENROLLED).alias(fv.ENROLLED),
        converted.alias("_converted"),
        cleared.alias("_cleared"),
    )
    return typed.withColumn("_missing", missing_share())


def harmonise(df: DataFrame) -> DataFrame:
    """Canonical education and marital labels, the education group, and how many labels changed spelling."""
    education, marital = F.col("Education"), F.col("Marital_Status")
    edu, mar = S.canonical_education(education), S.canonical_marital(marital)
    changed = known(edu != education).cast("long") + known(mar != marital).cast("long")
    return df.withColumns(
        {
            "Education": F.coalesce(edu, education, F.lit("Unknown")),
            "Marital_Status": S.group_label(mar, fv.MARITAL_GROUPS),
            "Education_Level": S.group_label(edu, fv.EDUCATION_GROUPS),
            "_respelled": changed,
        }
    )


def fold_duplicates(df: DataFrame) -> DataFrame:
    """Exact, ID and profile duplicates folded into their first row, with the counts each row stands for."""
    attributes = [c for c in df.columns if c not in (fv.ID, fv.ROW_ORDER)]
    exact = df.groupBy(*attributes, fv.ID).agg(F.min(fv.ROW_ORDER).alias(fv.ROW_ORDER), F.count("*").alias("_copies"))
    first = F.min_by(F.struct(*attributes, fv.ROW_ORDER), fv.ROW_ORDER)
    own = own_group_when_null(fv.ID).alias("_own")
    by_id = (
        exact.groupBy(fv.ID, own)
        .agg(first.alias("r"), F.sum("_copies").alias("_copies"), F.count("*").alias("_same_id"))
        .select(fv.ID, "r.*", "_copies", "_same_id", F.col(fv.ID).isNull().cast("long").alias("_no_id"))
    )
    labelled = harmonise(fill_missing_ids(by_id))
    profile = [*attributes, "Education_Level"]
    carried = ["_copies", "_same_id", "_no_id", "_respelled"]
    return labelled.groupBy(*profile).agg(
        F.min_by(fv.ID, fv.ROW_ORDER).alias(fv.ID),
        F.min(fv.ROW_ORDER).alias(fv.ROW_ORDER),
        F.count("*").alias("_profiles"),
        *[F.sum(c).alias(c) for c in carried],
    )


def clean_customers(raw: DataFrame, as_of: dt.date | None = None, rules: dict = fv.RULES) -> Cleaned:
    """Clean a canonical frame (``reshape.to_canonical``); ``as_of`` stands for today."""
    as_of = as_of or dt.date.today()
    dropped = constant_columns(raw, [*fv.REQUIRED, fv.ENROLLED, fv.ROW_ORDER])
    raw = raw.drop(*dropped)
    # text is parsed once; every later pass scans typed columns, and the blank-row test reaches the scan
    standard = stage_table(standardise(spread(raw)), "standard")
    before = standard.agg(
        F.count("*").alias("rows"), F.sum("_converted").alias("converted"), F.sum("_cleared").alias("cleared")
    ).first()

    filled = standard.filter(F.col("_missing") <= rules["max_missing_share"]).drop("_converted", "_cleared", "_missing")
    folded = stage_table(fold_duplicates(filled), "folded")
    future = known(F.col(fv.ENROLLED) > F.lit(as_of))
    n = folded.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("not_blank"),
        F.coalesce(F.sum("_same_id"), F.lit(0)).alias("exact"),
        F.coalesce(F.sum("_profiles"), F.lit(0)).alias("ids"),
        F.coalesce(F.sum("_no_id"), F.lit(0)).alias("no_id"),
        F.coalesce(F.sum("_respelled"), F.lit(0)).alias("respelled"),
        F.count("*").alias("profiles"),
        F.count_if(future).alias("future"),
        F.max(F.when(~future, F.year(fv.ENROLLED))).alias("latest_year"),
    ).first()
    latest_year = n["latest_year"] or as_of.year

    counters = ["_copies", "_same_id", "_profiles", "_no_id", "_respelled"]
    people = folded.drop(*counters).withColumn(fv.ENROLLED, S.clear_future(F.col(fv.ENROLLED), as_of))
    born, income, spend = implausible_birth(latest_year, rules), extreme_income(rules["max_income"]), spend_without_purchase()
    kept = people.filter(~born & ~income & ~spend)
    purchases = S.row_sum([F.col(c) for c in fv.CHANNELS])
    capped = kept.withColumns(
        {"NumDealsPurchases": S.cap_at(F.col("NumDealsPurchases"), purchases), "_day": F.unix_date(fv.ENROLLED).cast("double")}
    )
    others = [c for c in fv.NUMERIC if c != "Income"]
    blank = lambda cols: sum([F.col(c).isNull().cast("long") for c in cols], F.lit(0).cast("long"))
    stays = ~born & ~income & ~spend
    m = people.agg(
        F.count_if(born).alias("born"),
        F.count_if(~born & income).alias("income"),
        F.count_if(~born & ~income & spend).alias("spend"),
        F.count_if(stays & (F.col("NumDealsPurchases") > purchases)).alias("capped"),
        F.count_if(stays & F.col("Income").isNull()).alias("no_income"),
        F.count_if(stays & F.col(fv.ENROLLED).isNull()).alias("no_date"),
        F.coalesce(F.sum(F.when(stays, blank(others))), F.lit(0)).alias("no_other"),
    ).first()

    medians = fitted_medians(capped, [*others, "Income", "_day"])
    by_level = {r["Education_Level"]: r["value"] for r in exact_quantiles(capped, ["Income"], [0.5], ["Education_Level"]).collect()}
    day = None if medians.get("_day") is None else int(medians["_day"] // 1)
    group_income = S.lookup(by_level, F.col("Education_Level")) if by_level else F.lit(None).cast("double")
    customers = capped.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(medians.get(c))) for c in others},
            "Income": F.coalesce(F.col("Income"), group_income, F.lit(medians.get("Income"))),
            fv.ENROLLED: F.coalesce(F.col(fv.ENROLLED), F.date_from_unix_date(F.lit(day).cast("int"))),
        }
    ).drop("_day")
    customers = stage_table(customers, "clean")

    steps = []

    def log(wording, rows, *found):
        last = steps[-1][3] if steps else before["rows"]
        step, detail = wording
        steps.append((len(steps) + 1, step, last, rows, last - rows, detail.format(*found)))

    log(fv.STEP_CONSTANT, before["rows"], dropped)
    log(fv.STEP_NUMBERS, before["rows"], before["converted"] or 0, before["cleared"] or 0)
    log(fv.STEP_BLANK, n["not_blank"], rules["max_missing_share"])
    log(fv.STEP_EXACT, n["exact"])
    log(fv.STEP_IDS if n["no_id"] else (fv.STEP_IDS[0], ""), n["ids"], n["no_id"])
    log(fv.STEP_CATEGORIES, n["ids"], n["respelled"])
    log(fv.STEP_PROFILES, n["profiles"])
    log(fv.STEP_FUTURE, n["profiles"], n["future"], as_of)
    after = n["profiles"] - m["born"]
    log(fv.STEP_BIRTH, after, rules["min_birth_year"], latest_year - rules["min_customer_age"])
    after -= m["income"]
    log(fv.STEP_INCOME, after, rules["max_income"])
    after -= m["spend"]
    log(fv.STEP_SPEND, after)
    log(fv.STEP_DEALS, after, m["capped"])
    log(fv.STEP_IMPUTE, after, m["no_income"], m["no_date"], m["no_other"])
    return Cleaned(customers, raw.sparkSession.createDataFrame(steps, AUDIT_SCHEMA))


def cleaning_summary(audit: DataFrame) -> DataFrame:
    """One row with a one-line account of what was removed."""
    removed = F.filter(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "step", "rows_removed"))),
            lambda s: F.when(
                s["rows_removed"] > 0,
                F.concat(F.format_number(s["rows_removed"], 0), F.lit(" "), F.regexp_replace(s["step"], "^(Drop|Remove) ", "")),
            ),
        ),
        lambda t: t.isNotNull(),
    )
    return audit.agg(
        F.max("rows_before").alias("rows_raw"),
        F.min("rows_after").alias("rows_clean"),
        F.concat(F.lit("Removed "), F.array_join(removed, ", "), F.lit(".")).alias("summary"),
    )
