"""Column naming and schema checks; all of it is metadata work except the row guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions.scalars import name_key, to_flag
from kohort.sources.readers import UnreadableTable


def _spellings() -> dict[str, str]:
    names = {name_key(c): c for c in [*fv.REQUIRED, fv.ENROLLED, fv.ID]}
    return names | fv.COLUMN_ALIASES


def normalize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename recognisable columns to the canonical ones; an existing or already given name is never overwritten."""
    spellings = _spellings()
    df = df.toDF(*[c.strip() for c in df.columns])
    renames: dict[str, str] = {}
    for col in df.columns:
        target = spellings.get(name_key(col))
        if target and target != col and target not in df.columns and target not in renames.values():
            renames[col] = target
    out = df.withColumnsRenamed(renames)
    kinds = dict(out.dtypes)
    flags = {c: to_flag(F.col(c)) for c in fv.CAMPAIGNS if kinds.get(c) == "string"}
    return (out.withColumns(flags) if flags else out), renames


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    """Required columns that are neither present nor present as one-hot dummies."""
    present = set(df.columns)
    encoded = {p for p in fv.ONE_HOT_BASELINES if any(c.startswith(f"{p}_") for c in df.columns)}
    return [c for c in (required or fv.REQUIRED) if c not in present and c not in encoded]


def guard_rows(df: DataFrame, min_rows: int = 150, max_rows: int | None = None) -> int:
    """Number of rows if within bounds; with a maximum, reads at most one row more than it."""
    rows = df.select(F.lit(1))
    n = rows.count() if max_rows is None else rows.limit(max_rows + 1).count()
    if n == 0:
        raise UnreadableTable("The file contains no rows.")
    if max_rows is not None and n > max_rows:
        raise UnreadableTable(f"The file has more than {max_rows:,} rows.")
    if n < min_rows:
        raise UnreadableTable(f"At least {min_rows} rows are needed.")
    return n
