"""Word count; one function for tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Punctuation and white space, but neither apostrophe nor hyphen.
PUNCTUATION = r"""[!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~\s]+"""


def words(df: DataFrame, *text_cols: str, keep: list[str] | None = None) -> DataFrame:
    """``word`` for each non-empty part between spaces (or line ends) of each text column; nulls give none."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), "[ \n]") for c in text_cols]))
    return df.select(*(keep or []), F.explode(parts).alias("word")).filter("word <> ''")


def word_count(df: DataFrame, *text_cols: str) -> DataFrame:
    """``word, n``. On a stream: running totals."""
    return words(df, *text_cols).groupBy("word").agg(F.count("*").alias("n"))


def word_count_two_level(df: DataFrame, site: Column, *text_cols: str) -> DataFrame:
    """Counts within each site first, then over sites; the result is that of ``word_count``."""
    local = words(df.withColumn("_site", site), *text_cols, keep=["_site"]).groupBy("_site", "word").agg(F.count("*").alias("c"))
    return local.groupBy("word").agg(F.sum("c").alias("n"))


def word_count_lower(df: DataFrame, text_col: str) -> DataFrame:
    """Lower-cased words between punctuation and white space."""
    w = df.select(F.explode(F.split(F.lower(text_col), PUNCTUATION)).alias("word")).select(F.trim("word").alias("word"))
    return w.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k largest counts; ties by word. Fewer rows than k are no error."""
    return counts.orderBy(F.desc("n"), F.asc("word")).limit(k)


#: Bytes of input, as the planner sees them, to a partition of histograms: few enough that its words are counted in memory.
PART_BYTES = 4 << 20


def _by_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts dealt by id. They are smaller than rows for their words, which then need no shuffle."""
    df = df.select(id_col, text_col)
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >> 50:  # not known: the planner says past all sizes
        return df.repartition(id_col)
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-size // PART_BYTES)), id_col)


def histogram(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, word, n``: how often each document has each word."""
    return words(_by_id(df, id_col, text_col), text_col, keep=[id_col]).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def histogram_maps(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, words``: a map from word to frequency for each document."""
    h = histogram(df, id_col, text_col)
    return h.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("double")))).alias("words"))
