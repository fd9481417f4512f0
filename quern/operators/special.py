"""Link graphs of pages and lookups by token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst``: distinct addresses in href attributes."""
    found = F.expr(rf"regexp_extract_all(coalesce({html}, ''), 'href=[\"\']([^\"\'#]+)', 1)")
    return pages.select(F.col(url).alias("src"), F.explode(F.array_distinct(found)).alias("dst")).filter("src IS NOT NULL").distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``node, level``: nodes first reached after 0 to depth - 1 steps from ``start(node)``."""
    seen = cut(start.select("node").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, depth):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def with_token(df: DataFrame, col: str, salt: str = "") -> DataFrame:
    """A ``token`` beside each row: a hash of a column. A lookup aid, no protection of secrets."""
    return df.withColumn("token", F.sha2(F.concat(F.lit(salt), F.col(col).cast("string")), 256))


def point_query(df: DataFrame, token: str) -> DataFrame:
    return df.filter(F.col("token") == token)
