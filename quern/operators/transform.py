"""The transform job: addresses and dates restored by column name, then the last row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import restore_columns


def strip_prefix(key: str):
    """What follows the first ``:`` of a key; the whole key if there is none."""
    return F.regexp_replace(F.col(key), "^[^:]*:", "")


def transform(df: DataFrame, key: str, order: str) -> DataFrame:
    done = restore_columns(df).withColumn("_key", strip_prefix(key))
    row = F.struct(*[c for c in done.columns if c != "_key"])
    return done.groupBy("_key").agg(F.max_by(row, F.col(order)).alias("_r")).select(F.col("_key").alias("out_key"), "_r.*")
