"""K-means over sparse word vectors.

Similarity of a document to a centroid is the sum of products over common words, by the root of the centroid's
squared norm (1 at least); ties go to the lowest cluster, a document without common words to cluster 0.

Vectors are ``id, word, n``, or ``Bags`` of texts. Rows of an id and a word may be several; their numbers add up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import wordcount
from quern.session import cut

#: Words of centroids that go to every executor; words of larger centroids are met by shuffle, but for the most frequent.
HELD = 300_000
#: Clusters that are compared in one pass over the vectors.
WIDE = 16


class Bags:
    """Texts as vectors. They are joined whole and taken apart afterwards, so no row for each word is shuffled or stored."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.text_col = text_col
        # a text has words if it has a character other than those between words
        self.rows = docs.select(id_col, text_col).filter(F.col(text_col).cast("string").rlike("[^ \n]"))

    def words(self, rows: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` of ``rows`` with ``word, n``."""
        return wordcount.words(rows, self.text_col, keep=list(keep)).withColumn("n", F.lit(1))


class _Counted:
    """Vectors that are there as a table."""

    def __init__(self, vectors: DataFrame):
        self.rows = vectors

    def words(self, rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(*keep, "word", "n")


def _bags(vectors: DataFrame | Bags) -> Bags | _Counted:
    return vectors if isinstance(vectors, Bags) else _Counted(vectors)


def seeds(vectors: DataFrame | Bags, k: int, id_col: str = "doc_id") -> DataFrame:
    """``cluster, word, value`` of the k lowest ids."""
    bags = _bags(vectors)
    first = F.asc_nulls_last(id_col)
    ids = bags.rows.select(id_col).distinct().orderBy(first).limit(k)
    numbered = ids.select(id_col, (F.rank().over(Window.orderBy(first)) - 1).alias("cluster"))  # k rows
    words = bags.words(bags.rows.join(F.broadcast(numbered), id_col), "cluster")
    return words.groupBy("cluster", "word").agg(F.sum("n").cast("double").alias("value"))


def norms(centroids: DataFrame) -> DataFrame:
    """``cluster, norm``: squared norms."""
    return centroids.groupBy("cluster").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))


def _similar(bags: Bags | _Counted, centroids: DataFrame, norm_of: dict[int, float], id_col: str) -> DataFrame:
    """``id, b``: for each id the most similar of some clusters as ``sim, c`` (the cluster's negative), null if none has a word of it."""
    values = [f"_v{i}" for i in range(len(norm_of))]
    # a row for each word, so that a word is met once and not once for each cluster
    of = [(F.sum(F.when(F.col("cluster") == c, F.col("value"))) / math.sqrt(max(norm, 1.0))).alias(v) for v, (c, norm) in zip(values, norm_of.items(), strict=True)]
    weight = F.sum("total" if "total" in centroids.columns else "value")
    wide = cut(centroids.filter(F.col("cluster").isin(*norm_of)).groupBy("word").agg(*of, F.floor(F.log2(weight) * 8).alias("step")))
    words, columns = bags.words(bags.rows, id_col), [id_col, "n", *values]
    if wide.count() <= HELD:
        met = words.join(F.broadcast(wide), "word", "left")
    else:
        # as many of the heaviest words as may be held, all of a step of weights or none; their rows are met in place, others by shuffle
        least, held = 1 << 20, 0
        for step, count in sorted(map(tuple, wide.groupBy("step").count().filter("step IS NOT NULL").collect()), reverse=True):  # some hundred steps
            held += count
            if held > HELD:
                break
            least = step
        heavy = F.coalesce(F.col("step") >= least, F.lit(False))
        near, far = wide.filter(heavy), wide.filter(~heavy)
        rest = words.join(F.broadcast(near.select("word")), "word", "left_anti").join(far.hint("shuffle_hash"), "word")
        met = words.join(F.broadcast(near), "word", "left").select(*columns).unionByName(rest.select(*columns))
    sims = met.groupBy(id_col).agg(*[F.sum(F.col("n") * F.col(v)).alias(v) for v in values])
    found = [F.when(F.col(v) > 0, F.struct(F.round(v, 9).alias("sim"), F.lit(-c).cast("long").alias("c"))) for v, c in zip(values, norm_of, strict=True)]
    return sims.select(id_col, F.when(F.col(id_col).isNotNull(), F.array_max(F.array(*found))).alias("b"))


def assign(vectors: DataFrame | Bags, centroids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, cluster, sim`` for each document. centroids: cluster, word, value."""
    bags = _bags(vectors)
    found = [tuple(r) for r in norms(centroids).orderBy("cluster").collect()] or [(0, 0.0)]  # a row for each cluster
    parts = [_similar(bags, centroids, dict(found[i : i + WIDE]), id_col) for i in range(0, len(found), WIDE)]
    best = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.max("b").alias("b"))
    return best.select(id_col, F.coalesce(-F.col("b.c"), F.lit(0)).cast("int").alias("cluster"), F.coalesce("b.sim", F.lit(0.0)).alias("sim"))


def totals(vectors: DataFrame | Bags, assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``cluster, word, total``: word sums of each cluster."""
    bags = _bags(vectors)
    # no sort of texts; the ids of a partition are held
    joined = bags.rows.join(assigned.select(id_col, "cluster").hint("shuffle_hash"), id_col)
    return bags.words(joined, "cluster").groupBy("cluster", "word").agg(F.sum("n").alias("total"))


def _means(vectors: DataFrame | Bags, assigned: DataFrame, id_col: str) -> DataFrame:
    """``cluster, word, value, total``."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("docs"))
    # a row for each cluster
    return totals(vectors, assigned, id_col).join(F.broadcast(sizes), "cluster").select("cluster", "word", (F.col("total") / F.col("docs")).alias("value"), "total")


def update(vectors: DataFrame | Bags, assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``cluster, word, value``: new centroids, word sums by number of documents."""
    return _means(vectors, assigned, id_col).select("cluster", "word", "value")


def summary(vectors: DataFrame | Bags, assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``cluster, docs, words, norm``: documents, distinct words and squared norm of each new centroid."""
    new = update(vectors, assigned, id_col)
    per = new.groupBy("cluster").agg(F.count("*").alias("words"), F.sum(F.col("value") * F.col("value")).alias("norm"))
    return assigned.groupBy("cluster").agg(F.count("*").alias("docs")).join(per, "cluster", "left")


def members(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``cluster, ids``: ids of each cluster in order, joined by spaces."""
    return assigned.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(id_col)), " ").alias("ids"))


def fit(vectors: DataFrame | Bags, k: int = 2, max_iter: int = 1, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(assignment, centroids) after ``max_iter`` rounds or when no word of a centroid changes in its whole part.

    The centroids of the last round are computed when they are read."""
    whole = lambda c, name: c.select("cluster", "word", F.floor("value").alias(name)).filter(F.col(name) != 0)
    centroids = cut(seeds(vectors, k, id_col))
    for i in range(max_iter):
        assigned = cut(assign(vectors, centroids, id_col))
        old, centroids = centroids, _means(vectors, assigned, id_col)
        if i < max_iter - 1:
            centroids = cut(centroids)
            changed = whole(centroids, "new").join(whole(old, "old"), ["cluster", "word"], "full").filter("NOT (old <=> new)")
            if changed.isEmpty():
                break
    return assigned, centroids.select("cluster", "word", "value")
