"""Table writers and the versioned folder of published model tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from kohort.functions.scalars import sanitized


def sanitize_text(df: DataFrame) -> DataFrame:
    """Quote leading formula characters in every text column."""
    cells = {c: sanitized(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"}
    return df.withColumns(cells) if cells else df


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported format '{fmt}'.")


def save_as_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def export_segment(df: DataFrame, columns: list[str], segment: int | None = None, known: list[int] | None = None) -> DataFrame:
    """Fixed column order, optionally one segment; an unknown segment is an error."""
    if segment is not None and known is not None and segment not in known:
        raise KeyError(segment)
    out = df if segment is None else df.filter(F.col("Segment") == segment)
    return sanitize_text(out.select(*columns))


class PublishedTables:
    """Model tables kept as ``version=…`` folders, and a log of publications whose last entry names the live one.

    An entry is one small file that is added after the version is complete, and none is ever replaced, so readers see
    either the old or the new version. The versions published last are kept.
    """

    KEEP = 3
    _ENTRY = "number long, version string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _log(self) -> list[tuple[int, str | None]]:
        """(number, version) of every publication, oldest first; a version of None ends publication."""
        path = f"{self.root}/published"
        if not self._exists(path):
            return []
        return sorted(((r["number"], r["version"]) for r in self.spark.read.schema(self._ENTRY).parquet(path).collect()), key=lambda e: e[0])

    def _append(self, version: str | None) -> None:
        log = self._log()
        entry = self.spark.createDataFrame([(log[-1][0] + 1 if log else 1, version)], self._ENTRY)
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/published")

    def versions(self) -> list[str]:
        """Versions that are there, the latest published last."""
        if not self._exists(self.root):
            return []
        names = {s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))}
        at = {version: number for number, version in self._log()}
        return sorted((n.split("=", 1)[1] for n in names if n.startswith("version=")), key=lambda v: (at.get(v, 0), v))

    def publish(self, version: str, tables: dict[str, DataFrame]) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", version):
            raise ValueError("A version may hold letters, digits, '.', '_' and '-'.")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/version={version}/{name}")
        self._append(version)
        for old in self.versions()[: -self.KEEP]:
            if old != version:
                self._fs.delete(self._path(f"{self.root}/version={old}"), True)
        return version

    def live(self) -> str | None:
        log = self._log()
        return log[-1][1] if log and log[-1][1] in self.versions() else None

    def table(self, name: str) -> DataFrame:
        version = self.live()
        if version is None:
            raise LookupError("Nothing is published.")
        return self.spark.read.parquet(f"{self.root}/version={version}/{name}")

    def reset(self) -> None:
        if self.live() is not None:
            self._append(None)

    def status(self) -> DataFrame:
        live = self.live()
        rows = [(v, v == live) for v in self.versions()]
        return self.spark.createDataFrame(rows, "version string, live boolean")
