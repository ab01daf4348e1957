"""Bounds of a whole customer record, and questions for the first or last segment."""

from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.operators.filters import record_violations
from kohort.operators.ranking import superlative_answers

GOOD = {c: str(lo) for c, (lo, _) in fv.RECORD_BOUNDS.items()} | {c: "0" for c in fv.FLAGS} | {"Education": "PhD", "Marital_Status": "Single", "Dt_Customer": "2014-01-31"}


def _violations(spark, *changes):
    rows = [tuple((GOOD | c).values()) for c in changes]
    return [r["violations"] for r in record_violations(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in GOOD))).collect()]


def test_every_field_of_a_record_is_bounded(spark):
    assert len(GOOD) == 26
    wrong = {c: str(hi + 1) for c, (_, hi) in fv.RECORD_BOUNDS.items()} | {c: "2" for c in fv.FLAGS} | {"Education": "phd", "Marital_Status": "Alone", "Dt_Customer": "soon"}
    assert _violations(spark, {}, wrong, *[{c: v} for c, v in wrong.items()]) == [[], list(GOOD), *[[c] for c in wrong]]


def test_empty_fields_need_a_default_and_nan_is_out_of_bounds(spark):
    got = _violations(spark, {c: None for c in GOOD}, {"MntWines": "NaN"}, {"Income": "many"})
    assert got == [[c for c in GOOD if c not in fv.RECORD_MAY_BE_EMPTY], ["MntWines"], ["Income"]]


def test_missing_and_foreign_columns_and_real_flags(spark):
    df = spark.createDataFrame([(True, 7)], "AcceptedCmp1 boolean, other long")
    row = record_violations(df).first()
    assert row["other"] == 7 and row["violations"] == [*fv.RECORD_BOUNDS][:1] + [c for c in fv.RECORD_BOUNDS if c not in ("Year_Birth", "Income")] + ["Dt_Customer"]


def test_questions_find_metric_and_direction_in_a_sentence(spark):
    metrics = sorted(set(fv.METRIC_WORDS.values()))
    rows = [(s, f"S{s}", *[float(v) for _ in metrics]) for s, v in ((0, 2), (1, 5), (2, 5), (3, 2))]
    profiles = spark.createDataFrame(rows, "Segment int, Segment_Name string, " + ", ".join(f"`{m}` double" for m in metrics))
    profiles = profiles.withColumn("Avg_Age", F.lit(None).cast("double"))
    asked = {
        "Which segment spends the most?": ("Avg_Total_Spend", False, 1),  # inside a longer word
        "which customers have the LOWEST income": ("Median_Income", True, 0),
        "who is the best group by deal use": ("Deal_Ratio_%", False, 1),
        "the segment with the highest or lowest tenure": ("Avg_Tenure_Days", True, 0),
        "which segment is the oldest by age": ("Avg_Age", False, None),
        "tell me the highest income": None,
        "which segment has income": None,
        "": None,
    }
    df = spark.createDataFrame([(q,) for q in [*asked, None]], "q string")
    got = {r["q"]: r for r in superlative_answers(df, "q", profiles).collect()}
    for q, want in (asked | {None: None}).items():
        r = got[q]
        assert (r["metric"], r["lowest"], r["Segment"]) == (want or (None, None, None)), q
