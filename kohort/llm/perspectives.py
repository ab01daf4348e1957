"""Every dialogue from the side of every participant.

For each participant of a conversation (every role but ``system``) the whole dialogue is rendered once: that speaker's turns
as the assistant's, all others as turns of a user with the speaker's name, system turns as they are. The result has a row for
each turn of each rendering, in order, so that no dialogue has to fit into a row: the rendered turn, its first character in
the dialogue, and the characters [mask_start, mask_end) on which a model is to be trained: the text and end mark of the
assistant's turns; an empty span elsewhere.

Turns are ordered by turn, role and text, nulls first. Places come from running sums inside stretches of ``STRETCH`` turn
numbers and over the stretches, so a conversation of any length is spread over tasks. A null role is the speaker ``unknown``;
a null text is empty; rows with a null conversation id are one conversation; repeated rows are repeated turns; a conversation
with system turns only, and an empty table, give no rows. Columns beyond the four play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STRETCH = 256
END = "<|end|>\n"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, place (from 1), turn, speaker, rendered, start, mask_start, mask_end."""
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    each = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").select("*", head.alias("head"), own.alias("own")).withColumn("rendered", F.concat("head", "text", F.lit(END)))
    each = each.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(0)) / STRETCH)).withColumn("n", F.length("rendered").cast("long"))

    keys = ["conv_id", "perspective"]
    order = [F.col("turn").asc_nulls_first(), "speaker", "text"]
    inside = Window.partitionBy(*keys, "stretch").orderBy(*order)
    each = each.withColumn("place", F.row_number().over(inside)).withColumn("before", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    over = Window.partitionBy("c", "p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows_of(each, keys).select("c", "p", "s", F.coalesce(F.sum("chars").over(over), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(over), F.lit(0)).alias("turns"))
    out = each.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("stretch") == F.col("s")))
    start = F.col("chars") + F.col("before")
    return out.select(
        "conv_id",
        "perspective",
        (F.col("turns") + F.col("place")).alias("place"),
        "turn",
        "speaker",
        "rendered",
        start.alias("start"),
        (start + F.when(F.col("own"), F.length("head")).otherwise(0)).alias("mask_start"),
        (start + F.when(F.col("own"), F.col("n")).otherwise(0)).alias("mask_end"),
    )


def rows_of(each: DataFrame, keys: list[str]) -> DataFrame:
    """Characters and turns of each stretch."""
    return each.groupBy(*keys, "stretch").agg(F.sum("n").alias("chars"), F.count("*").alias("turns")).toDF("c", "p", "s", "chars", "turns")


SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
e AS (SELECT t.*, perspective, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM e),
w AS (SELECT *, row_number() OVER o AS place, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM r WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, place, turn, speaker, rendered, CAST(start AS BIGINT) AS start,
  CAST(start AS BIGINT) + CASE WHEN own THEN length(head) ELSE 0 END AS mask_start,
  CAST(start AS BIGINT) + CASE WHEN own THEN length(rendered) ELSE 0 END AS mask_end FROM w"""
