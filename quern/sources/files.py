"""Loaders and sinks: text lines, capped loads, word histograms, wiki files, blobs, text maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.wordcount import histogram_maps
from quern.session import cut


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, line`` for each line of the text files of a folder."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def line_blocks(spark: SparkSession, path: str, lines_each: int = 1000) -> DataFrame:
    """``file, block, lines``: runs of ``lines_each`` lines of each file, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\n$", ""), "\n").alias("l"))
    n = F.ceil(F.size("l") / lines_each).cast("int")
    return whole.select("file", "l", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("file", "block", F.expr(f"slice(l, block * {lines_each} + 1, {lines_each})").alias("lines"))


def capped(df: DataFrame, col: str, max_bytes: int, order: str) -> DataFrame:
    """Rows in order until their text reaches ``max_bytes``; the row that crosses the limit is the last.

    Rows are dealt by ranges of ``order``; one row for each range is added up in order, then the rows of each range.
    """
    size = F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
    dealt = cut(df.withColumn("_b", size).repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    upto = lambda w: F.coalesce(F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("_p").agg(F.sum("_b").alias("_b")).select("_p", upto(Window.orderBy("_p")).alias("_before"))
    wanted = ranges.filter(F.col("_before") < max_bytes)  # a row for each range
    rows = dealt.join(F.broadcast(wanted), "_p").withColumn("_own", upto(Window.partitionBy("_p").orderBy(order)))
    return rows.filter(F.col("_before") + F.col("_own") < max_bytes).select(*[F.col(f"`{c}`") for c in df.columns])


def word_histograms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A word-to-frequency map for each document, its id under ``~``."""
    h = histogram_maps(docs, id_col, text_col)
    return h.select(F.map_concat("words", F.create_map(F.lit("~"), F.col(id_col).cast("double"))).alias("fields"))


def wiki_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, doc, text``: documents that begin after a line starting `` doc id`` and end at a line `` doc``."""
    whole = spark.read.option("pathGlobFilter", "*.wiki").text(path, wholetext=True)
    parts = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.expr(r"regexp_extract_all(concat(value, '\n'), '(?m)^ doc id[^\\n]*\\n((?:(?! doc$)[^\\n]*\\n)*?) doc$', 1)")).alias("doc", "text"))
    return parts.select("file", "doc", F.regexp_replace("text", "\n$", "").alias("text"))


def blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, length, content`` of files."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


class BlobStore:
    """Named blobs in numbered parts under a folder of any file system that Spark knows by its URI scheme."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, name: str, data: bytes, part: int = 0) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}/{part:08d}"), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def write_chunks(self, name: str, data: bytes, size: int) -> int:
        """Write in parts of ``size`` bytes; returns how many."""
        cuts = range(0, max(1, len(data)), size)
        for n, a in enumerate(cuts):
            self.write(name, data[a : a + size], n)
        return len(cuts)

    def parts(self, name: str) -> list[str]:
        p = self._path(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> bytes:
        """All parts in order."""
        rows = blobs(self.spark, f"{self.root}/{name}").orderBy("path").select("content").collect()
        return b"".join(bytes(r[0]) for r in rows)

    def size(self, name: str) -> int:
        return blobs(self.spark, f"{self.root}/{name}").agg(F.sum("length")).first()[0] or 0

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def download(self, name: str, target: str) -> None:
        with open(target, "wb") as f:
            for row in blobs(self.spark, f"{self.root}/{name}").orderBy("path").select("content").toLocalIterator():
                f.write(bytes(row[0]))


def save_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """Lines ``\\t key--->value``."""
    df.select(F.concat(F.lit("\t "), F.col(key).cast("string"), F.lit("--->"), F.coalesce(F.col(value).cast("string"), F.lit("null"))).alias("value")).write.mode("overwrite").text(path)


def pretty(df: DataFrame, n: int = 20, null: str = "NULL") -> str:
    """A bordered table of the first n rows."""
    rows = [[null if v is None else str(v) for v in r] for r in df.limit(n).collect()]
    width = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, width, strict=True)) + "|"
    return "\n".join([rule, line(df.columns), rule, *map(line, rows), rule])
