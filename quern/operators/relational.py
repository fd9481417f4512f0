"""Relational operators over DataFrames, by name lists and specs rather than by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, targets: dict[str, str | list[str]]) -> DataFrame:
    """Only the targets, each renamed; one source may go to several names."""
    return df.select(*[F.col(src).alias(name) for src, to in targets.items() for name in ([to] if isinstance(to, str) else to)])


def keep_only(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in set(cols)])


def remove(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def qualify(df: DataFrame, table: str) -> DataFrame:
    """All columns under ``table.column``."""
    return df.select(*[F.col(f"`{c}`").alias(f"{table}.{c}") for c in df.columns])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def attribute_equals(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows whose column, as text, is ``value``."""
    return df.filter(F.col(col).cast("string") == value)


def key_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows with a numeric key in [low, high]; keys that are not numbers are out."""
    return df.filter(F.col(key).try_cast("bigint").between(low, high))


def first_n(df: DataFrame, n: int | None = None) -> DataFrame:
    return df if n is None else df.limit(n)


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", drop: tuple[str, ...] = ()) -> DataFrame:
    """Equi-join. Where both sides have a column, the right one stays; ``drop`` names columns to leave out of both."""
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in keys]
    joined = l.join(r, on, how)
    cols = [F.col(f"l.`{c}`") for c in left.columns if c not in right.columns and c not in drop]
    return joined.select(*cols, *[F.col(f"r.`{c}`") for c in right.columns if c not in drop])


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """By (column, ascending) pairs; nulls last either way."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def page(df: DataFrame, low: int, high: int, *keys: tuple[str, bool]) -> DataFrame:
    """Rows low to high (from 0, both included) in the order of ``keys``; nothing is used up."""
    return sort(df, *keys).offset(low).limit(high - low + 1)


def union_sites(*parts: DataFrame) -> DataFrame:
    """The rows of all sites."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_concat(df: DataFrame, key: str, col: str, order: str, sep: str = "") -> DataFrame:
    """SUM over text: values joined in the order of another column."""
    pairs = F.array_sort(F.collect_list(F.struct(order, col)))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p[col]), sep).alias("text"))


def run_stats(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, deviation and bounds of a column."""
    c = F.col(col)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"))
