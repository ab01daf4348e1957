"""Table readers: delimited text, JSON in its usual shapes, parquet and the catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from kohort.fixed_values import ROW_ORDER
from kohort.session import stage_table

EXTENSIONS = {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "json": "json", "jsonl": "lines", "ndjson": "lines"}
WRAPPERS = ["data", "customers", "records", "rows", "items"]


class UnreadableTable(ValueError):
    """The input is not a table this package can read."""


def with_row_order(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add the explicit load order that keep-first rules refer to.

    ``key`` names an increasing, unique integer column when the table has one. Otherwise rows are numbered from 0 without gaps: files
    in order of their paths, parts of a file by where they start, rows as they stand. How the parts are dealt over tasks does not
    matter. Frames that are not read straight from files are written first, which fixes their order. An empty table stays empty, and
    a column of this name is replaced.

    Rows are counted by part in a first pass; the counts, one row per part, are added up within files and then over files.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != ROW_ORDER]
    if key:
        return df.withColumn(ROW_ORDER, F.col(key).cast("long"))
    mark = "_".join(["mark", *df.columns])
    place = F.monotonically_increasing_id()
    try:
        marked = df.select(*keep, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("place")).alias(mark))
    except AnalysisException:  # no files behind these rows
        written = stage_table(df.select(*keep, place.alias(mark)), "ordered")
        marked = written.withColumn(mark, F.struct(F.lit("").alias("file"), F.shiftright(F.col(f"`{mark}`"), 33).alias("start"), F.col(f"`{mark}`").alias("place")))
    at = lambda field: F.col(f"`{mark}`.{field}")
    parts = marked.groupBy(at("file").alias("_file"), at("start").alias("_start")).agg(F.min(at("place")).alias("_first"), F.count("*").alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = parts.groupBy("_file").agg(F.sum("_n").alias("_n"))
    files = files.select(F.col("_file").alias("_of"), earlier(Window.orderBy("_file")).alias("_before"))  # one row per file
    parts = parts.withColumn("_within", earlier(Window.partitionBy("_file").orderBy("_start"))).join(files, F.col("_file") == F.col("_of"))
    offsets = parts.select("_file", "_start", (F.col("_before") + F.col("_within") - F.col("_first")).alias(f"{mark}_offset"))
    rows = marked.join(offsets, (at("file") == F.col("_file")) & (at("start") == F.col("_start")))
    return rows.select(*keep, (at("place") + F.col(f"`{mark}_offset`")).alias(ROW_ORDER))


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def header_separator(spark: SparkSession, path: str, sniff: bool = False) -> str:
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise UnreadableTable("The file is empty.")
    line = head[0][0]
    if not sniff:
        return "\t" if line.count("\t") > line.count(",") else ","
    return max([",", "\t", ";", "|"], key=line.count)


def read_delimited(spark: SparkSession, path: str, sniff: bool = False) -> DataFrame:
    """Every column as text; the cleaning expressions decide what is a number, flag or date."""
    sep = header_separator(spark, path, sniff)
    return _trimmed(spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"'))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return _trimmed(spark.read.option("mode", "FAILFAST").json(path))


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested fields become top-level columns joined with ``_``; the order of fields is kept."""

    def leaves(field_type, path, name):
        if isinstance(field_type, T.StructType):
            for f in field_type.fields:
                yield from leaves(f.dataType, f"{path}.`{f.name}`", f"{name}_{f.name}")
        else:
            yield F.col(path).alias(name)

    out = []
    for f in df.schema.fields:
        out += list(leaves(f.dataType, f"`{f.name}`", f.name))
    return df.select(*out)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, an object that wraps one, a column-oriented object, or a single record."""
    df = spark.read.option("mode", "FAILFAST").json(path, multiLine=True)
    types = {f.name: f.dataType for f in df.schema.fields}
    for key in WRAPPERS:
        if isinstance(types.get(key), T.ArrayType):
            if not isinstance(types[key].elementType, T.StructType):
                raise UnreadableTable("JSON must be a list of records or an object with a list of records.")
            return _trimmed(flatten_structs(df.select(F.inline(key))))
    if types and all(isinstance(t, T.ArrayType) for t in types.values()):
        return _trimmed(df.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in types]))))
    if types and all(isinstance(t, T.StructType) for t in types.values()) and len(types) > 1:
        return _trimmed(_from_indexed_columns(spark, path, types))
    return _trimmed(flatten_structs(df))


def _from_indexed_columns(spark, path, types):
    """``{"a": {"0": …, "1": …}, "b": {…}}``: each column is a map from row label to value."""
    schema = T.StructType([T.StructField(c, T.MapType(T.StringType(), t.fields[0].dataType)) for c, t in types.items()])
    maps = spark.read.schema(schema).json(path, multiLine=True)
    first = next(iter(types))
    rows = maps.select("*", F.posexplode(F.map_keys(F.col(f"`{first}`"))).alias("_pos", "_key"))
    return rows.select(*[F.try_element_at(F.col(f"`{c}`"), F.col("_key")).alias(c) for c in types])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the file extension."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    kind = EXTENSIONS.get(ext)
    if kind is None:
        raise UnreadableTable(f"Unsupported file type '{ext or 'unknown'}'. Use delimited text or JSON.")
    if kind == "delimited":
        return read_delimited(spark, path, sniff=True)
    return read_json_lines(spark, path) if kind == "lines" else read_json_document(spark, path)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def load_source(spark: SparkSession, table: str | None = None, query: str | None = None) -> DataFrame:
    """A catalog table or the result of a query; the query wins, and the first table is the default."""
    if query:
        return spark.sql(query)
    if not table:
        names = list_tables(spark)
        if not names:
            raise UnreadableTable("The catalog contains no tables.")
        table = names[0]
    return spark.table(table)


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
