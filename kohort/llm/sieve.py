"""A fixed-size filter that keeps rows which may be in a set of keys, so that fewer texts are shuffled for a join.

``BITS`` bits (4 MB) whatever the number of keys. Rows of the set always pass; others pass now and then, more often the fuller
the filter, and are dropped by the join that follows. Results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 25
_BUCKET = 32_768


def _spot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``."""
    spots = wanted.select(_spot(keys).alias("_x"))
    parts = spots.groupBy(F.bitmap_bucket_number("_x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("m"))
    bits = np.zeros((BITS // _BUCKET + 1, _BUCKET // 8), dtype=np.uint8)
    for r in parts.collect():
        bits[r.b - 1] = np.frombuffer(r.m, dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches):
        table = shared.value
        for batch in batches:
            x = batch.column(batch.num_columns - 1).to_numpy() - 1
            keep = (table[x >> 3] >> (x & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep.astype(bool)))

    return rows.withColumn("_x", _spot(keys)).mapInArrow(run, rows.schema)
