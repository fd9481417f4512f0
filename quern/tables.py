"""Tables of a data folder, and key-value table helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make the named tables temp views, as the default tables of a session."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def latest(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row for each key: the last by ``order`` (a second put of a key overwrites the first).

    Uses ``max_by`` over the whole row, so a map-side combine leaves one row per key and task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    seq = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, seq).alias("_r")).select("_r.*")


def put(table_df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table_df`` after ``rows`` are put: rows with a known key replace, others are added.

    Of several put rows with one key, the last by all columns' order stays, so the result does not depend on partitioning.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in rows.columns])
    new = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return table_df.join(new.select(key), key, "left_anti").unionByName(new)


def put_if_absent(table_df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table_df`` with those ``rows`` whose key it lacks."""
    return table_df.unionByName(rows.join(table_df.select(key), key, "left_anti"))


def get(df: DataFrame, key: str, value, attributes: list[str] | None = None) -> DataFrame:
    """Point lookup; with ``attributes`` only those columns."""
    found = df.filter(F.col(key) == F.lit(value))
    return found.select(*attributes) if attributes else found


def batch_get(df: DataFrame, key: str, low: int = -1, high: int = -1) -> DataFrame:
    """Rows with a key in [low, high]; a negative bound is no bound."""
    if low >= 0:
        df = df.filter(F.col(key) >= low)
    if high >= 0:
        df = df.filter(F.col(key) <= high)
    return df


def contains(df: DataFrame, key: str, value) -> bool:
    return not df.filter(F.col(key) == F.lit(value)).limit(1).isEmpty()
