"""Count-min sketch whose hash is Java's: row i takes the i-th draw of Random(hashCode(word)) below w.

With ``single`` the hash is that of the queries' SQL: over code points, and a draw that Java would repeat is taken as it is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import code_point_hash, java_hash, random_accepted, random_below, random_next, random_seed
from quern.operators.wordcount import words


def sizes(delta: float = 0.02, epsilon: float = 0.9) -> tuple[int, int]:
    """(w, d) for the wanted error and certainty."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def with_cells(df: DataFrame, w: int, d: int, word_col: str = "word", single: bool = False) -> DataFrame:
    """A row for each sketch row: ``row, col`` beside the columns of ``df``."""
    df = df.withColumn("_s", random_seed((code_point_hash if single else java_hash)(F.col(word_col))))
    cells = []
    for i in range(d):
        df = df.withColumn(f"_s{i}", random_next(F.col(f"_s{i - 1}" if i else "_s")))
        if not single:
            df = df.withColumn(f"_s{i}", random_accepted(F.col(f"_s{i}"), w))
        cells.append(F.struct(F.lit(i).alias("row"), random_below(F.col(f"_s{i}"), w).alias("col")))
    out = df.withColumn("_c", F.explode(F.array(*cells)))
    return out.select(*[c for c in df.columns if not c.startswith("_s")], "_c.row", "_c.col")


def cells(df: DataFrame, w: int, d: int, *text_cols: str, single: bool = False) -> DataFrame:
    """``row, col, n``: the long form. Words are counted first, so each distinct word is hashed once. Not for streams."""
    counts = words(df, *text_cols).groupBy("word").agg(F.count("*").alias("c"))
    return with_cells(counts, w, d, single=single).groupBy("row", "col").agg(F.sum("c").alias("n"))


def cells_stream(df: DataFrame, w: int, d: int, *text_cols: str, single: bool = False) -> DataFrame:
    """As ``cells`` with one aggregate, as streams need."""
    return with_cells(words(df, *text_cols), w, d, single=single).groupBy("row", "col").agg(F.count("*").alias("n"))


def rows(cell_counts: DataFrame, w: int) -> DataFrame:
    """``row, counts``: each row as comma-joined cells."""
    m = cell_counts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "n"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("string"))
    return m.select("row", F.array_join(at, ",").alias("counts"))


def estimate(cell_counts: DataFrame, probes: DataFrame, w: int, d: int, single: bool = False) -> DataFrame:
    """``word, estimate``: the least of a word's cells. An addition; sketches alone do not need it."""
    asked = with_cells(probes.select("word"), w, d, single=single)
    # at most w * d cells
    got = asked.join(F.broadcast(cell_counts), ["row", "col"], "left")
    return got.groupBy("word").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
