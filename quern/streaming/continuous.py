"""Continuous jobs: the batch functions over streams, windows over change feeds, and listeners.

A finished stream (``available_now``) gives the batch result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import countmin, kmeans, wordcount
from quern.plans.job import Job, local_stage, reduce_stage
from quern.session import checkpoint_dir, cut, ship


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream; its schema is read from it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def finish(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its final rows, which are written as Parquet beside the checkpoints.

    Each micro-batch has a folder of its own, written anew if the batch is repeated; of complete results the last holds.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def each(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/{n}")
        written.append(n)

    q = stream.writeStream.outputMode(mode).foreachBatch(each).trigger(availableNow=True)
    q.option("checkpointLocation", f"{folder}/offsets").start().awaitTermination()
    last = written[-1:] if mode == "complete" else sorted(set(written))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows/{n}" for n in last]) if last else _empty(spark, stream.schema)


class Increments:
    """A stream reduced batch by batch: ``step`` makes partial results of a micro-batch, ``merge`` makes the result of all so far.

    Partial results are Parquet in a folder for each batch, written anew if the batch is repeated, so nothing is counted
    twice. Both are plain functions of tables, so any job can run continuously; ``result`` may be asked for while it runs.
    """

    def __init__(self, stream: DataFrame, step: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]):
        self.stream, self.step, self.merge, self.spark = stream, step, merge, stream.sparkSession
        self.folder = f"{checkpoint_dir(self.spark)}/increments-{uuid.uuid4().hex}"
        self.schema = step(_empty(self.spark, stream.schema)).schema
        self.batches: set[int] = set()
        self.query: StreamingQuery | None = None

    def _each(self, df: DataFrame, n: int) -> None:
        self.step(df).write.mode("overwrite").parquet(f"{self.folder}/rows/{n}")
        self.batches.add(n)

    def start(self, seconds: float | None = None) -> StreamingQuery:
        """Run every ``seconds``, else once over all that is there now."""
        writer = self.stream.writeStream.foreachBatch(self._each).option("checkpointLocation", f"{self.folder}/offsets")
        self.query = (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
        return self.query

    def progress(self) -> dict:
        """Batches done and rows read so far."""
        done = self.query.recentProgress if self.query else []
        return {"batches": len(self.batches), "rows": sum(p["numInputRows"] for p in done)}

    def stop(self) -> None:
        if self.query:
            self.query.stop()

    def result(self) -> DataFrame:
        done = [f"{self.folder}/rows/{n}" for n in sorted(self.batches)]
        return self.merge(self.spark.read.schema(self.schema).parquet(*done) if done else _empty(self.spark, self.schema))

    def finish(self) -> DataFrame:
        """Run over all that is there now, and the result."""
        self.start().awaitTermination()
        return self.result()


def map_reduce(stream: DataFrame, job: Job) -> Increments:
    """A map-reduce job with user functions over a stream: ``key, value`` as ``run_generic`` gives for the rows so far.

    Each micro-batch is mapped, combined and reduced by site; the reducer sees all of that when the result is asked for.
    """
    return Increments(stream, lambda df: local_stage(df, job), lambda pairs: reduce_stage(pairs, job))


def word_count(stream: DataFrame, *cols: str) -> DataFrame:
    return wordcount.word_count(stream, *cols)


def count_min(stream: DataFrame, w: int, d: int, *cols: str, single: bool = False) -> DataFrame:
    return countmin.cells_stream(stream, w, d, *cols, single=single)


def k_means_sums(stream: DataFrame, centroids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Increments:
    """``cluster, word, total``: running sums of words, and rows with a null word for the number of documents.

    Each micro-batch is assigned as a table is.
    """

    def step(df: DataFrame) -> DataFrame:
        vectors = kmeans.Bags(df, id_col, text_col)
        of = cut(kmeans.assign(vectors, centroids, id_col).select(id_col, "cluster"))
        sums = kmeans.totals(vectors, of, id_col)
        return sums.unionByName(of.groupBy("cluster").agg(F.count("*").alias("total")).select("cluster", F.lit(None).cast("string").alias("word"), "total"))

    return Increments(stream, step, lambda parts: parts.groupBy("cluster", "word").agg(F.sum("total").alias("total")))


def time_window(stream: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) by event-time window and keys; the time column is cast to a zoned timestamp in UTC sessions."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        s = s.withWatermark("_ts", late)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return s.groupBy(F.window("_ts", width).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("begin"), *keys, "n", *(["total"] if value else []))


def _events(stream: DataFrame, group: str, key: str, value: str) -> DataFrame:
    ops = F.col("op") if "op" in stream.columns else F.lit("CREATED")
    seq = F.col("seq") if "seq" in stream.columns else F.lit(0)
    return stream.select(F.col(group).cast("string").alias("group"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), ops.alias("op"), seq.cast("long").alias("seq"))


def count_window(stream: DataFrame, group: str, key: str, value: str, size: int) -> DataFrame:
    """Tumbling windows of ``size`` distinct keys for each group: ``group, window, keys, total``.

    Within a window a later value of a key replaces the earlier one, and a row whose ``op`` is REMOVED takes the
    key out. A full window is emitted and emptied; what is left at the end stays in the state until ``flush`` rows
    (op FLUSH) ask for it (``CountWindows`` flushes by itself). State: one window for each group. The rows of a group in
    one micro-batch are put in order first.
    """
    ship(stream.sparkSession)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, names, values = state.get if state.exists else (0, [], [])
        held = dict(zip(names, values, strict=True))
        out = []
        for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
            total = _put(held, r.key, r.value, r.op, size)
            if total is not None:
                out.append((keys[0], number, *total))
                number += 1
        state.update((number, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["group", "window", "keys", "total"])

    rows = _events(stream, group, key, value)
    return rows.groupBy("group").applyInPandasWithState(run, "group string, window long, keys long, total double", "number long, names array<string>, values array<double>", "append", "NoTimeout")


def _put(held: dict[str, float], key: str, value: float, op: str, size: int) -> tuple[int, float] | None:
    """Put a row into a window; (keys, total) of the window if that ends it."""
    if op == "REMOVED":
        held.pop(key, None)
    elif op != "FLUSH":
        held[key] = value
    if len(held) < size and not (op == "FLUSH" and held):
        return None
    out = (len(held), float(sum(held.values())))
    held.clear()
    return out


class CountWindows:
    """Count windows as of ``count_window`` that are flushed at the end. Open windows are a table, one version for each micro-batch.

    A micro-batch is read group by group in order, one row at a time, so a group may be of any size.
    """

    CLOSED, OPEN = "group string, window long, keys long, total double", "group string, number long, names array<string>, values array<double>"

    def __init__(self, stream: DataFrame, group: str, key: str, value: str, size: int):
        self.events, self.size, self.spark = _events(stream, group, key, value), size, stream.sparkSession
        self.folder = f"{checkpoint_dir(self.spark)}/windows-{uuid.uuid4().hex}"
        self.batches: list[int] = []
        ship(self.spark)

    def _table(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}/{n}"

    def _each(self, df: DataFrame, n: int) -> None:
        size = self.size
        before = [b for b in self.batches if b < n]
        held = self.spark.read.schema(self.OPEN).parquet(self._table("open", before[-1])) if before else _empty(self.spark, self.OPEN)
        # the open window of a group comes before its rows
        rows = df.select("group", "seq", F.lit(1).alias("at"), "key", "value", "op", F.lit(0).cast("long").alias("number"), F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("array<double>").alias("values"))
        state = held.select("group", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("at"), F.lit("").alias("key"), F.lit(0.0).alias("value"), F.lit("").alias("op"), "number", "names", "values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, number, window, out = None, 0, {}, []
            opened = lambda: (here, number, None, None, list(window), list(window.values()))
            started = False
            for b in batches:
                for group, _, at, key, value, op, count, names, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not started or group != here:
                        if started:
                            out.append(opened())
                        started, here, number, window = True, group, 0, {}
                    if at == 0:
                        number, window = count, dict(zip(names, values, strict=True))
                        continue
                    total = _put(window, key, value, op, size)
                    if total is not None:
                        out.append((here, number, *total, None, None))
                        number += 1
                yield rows_of(out)
                out = []
            if started:
                yield rows_of([opened()])

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["group", "window", "keys", "total", "names", "values"])

        ordered = rows.unionByName(state).repartition("group").sortWithinPartitions("group", "at", "seq")
        done = cut(ordered.mapInArrow(run, self.CLOSED + ", names array<string>, values array<double>"))
        done.filter("names IS NULL").select("group", "window", "keys", "total").write.mode("overwrite").parquet(self._table("closed", n))
        done.filter("names IS NOT NULL").select("group", F.col("window").alias("number"), "names", "values").write.mode("overwrite").parquet(self._table("open", n))
        self.batches = sorted({*self.batches, n})

    def finish(self) -> DataFrame:
        """Run over all that is there now, and flush: ``group, window, keys, total`` of all windows."""
        q = self.events.writeStream.foreachBatch(self._each).option("checkpointLocation", f"{self.folder}/offsets").trigger(availableNow=True)
        q.start().awaitTermination()
        if not self.batches:
            return _empty(self.spark, self.CLOSED)
        closed = self.spark.read.schema(self.CLOSED).parquet(*[self._table("closed", n) for n in self.batches])
        left = self.spark.read.schema(self.OPEN).parquet(self._table("open", self.batches[-1])).filter("size(names) > 0")
        total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
        return closed.unionByName(left.select("group", F.col("number").alias("window"), F.size("names").cast("long").alias("keys"), total.alias("total")))


def processing_window(stream: DataFrame, group: str, key: str, value: str, millis: int) -> DataFrame:
    """Windows of ``millis`` of the machine's clock for each group: ``group, window, keys, total``.

    The first rows after the time is up end a window and are its last. A key counts with its last value, REMOVED takes it
    out, and a value that is older than ``millis`` counts no more.
    """
    ship(stream.sparkSession)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        number, began, names, values, at = state.get if state.exists else (0, now, [], [], [])
        held = dict(zip(names, zip(values, at, strict=True), strict=True))
        out = []
        for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.op == "REMOVED":
                held.pop(r.key, None)
            elif r.op != "FLUSH":
                held[r.key] = (r.value, now)
        if now - began >= millis:
            live = [v for v, t in held.values() if now - t <= millis]
            if live:
                out.append((keys[0], number, len(live), float(sum(live))))
                number += 1
            began, held = now, {}
        state.update((number, began, list(held), [v for v, _ in held.values()], [t for _, t in held.values()]))
        yield pd.DataFrame(out, columns=["group", "window", "keys", "total"])

    kept = "number long, began long, names array<string>, values array<double>, at array<long>"
    rows = _events(stream, group, key, value)
    return rows.groupBy("group").applyInPandasWithState(run, "group string, window long, keys long, total double", kept, "append", "NoTimeout")


def windowed(stream: DataFrame, group: str, key: str, value: str, configuration: dict) -> DataFrame:
    """The window that a job's configuration names: ``window`` is sizeBased, timeBased (milliseconds) or else single rows; ``windowSize``, 1 if absent."""
    kind, size = configuration.get("window"), int(configuration.get("windowSize", 1))
    if kind == "timeBased":
        return processing_window(stream, group, key, value, size)
    return count_window(stream, group, key, value, size if kind == "sizeBased" else 1)


def count_windows_of(rows: list[tuple[str, float, str]], size: int) -> list[tuple[int, int, float]]:
    """(window, keys, total) of one group's (key, value, op) rows; the definition that ``count_window`` follows."""
    held: dict[str, float] = {}
    out: list[tuple[int, int, float]] = []
    for key, value, op in rows:
        total = _put(held, key, value, op, size)
        if total is not None:
            out.append((len(out), *total))
    return out


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The change feed between two states of a table: ``op`` (CREATED, MODIFIED, REMOVED), the key, and the rows ``old`` and ``new``.

    Rows that are alike in all columns are no change. Keys occur once in each state.
    """
    a = old.select(F.col(key).alias("key"), F.struct(*[F.col(c) for c in old.columns]).alias("old"))
    b = new.select(F.col(key).alias("key"), F.struct(*[F.col(c) for c in new.columns]).alias("new"))
    both = a.join(b, "key", "full").filter("NOT (old <=> new)")
    op = F.when(F.col("old").isNull(), "CREATED").when(F.col("new").isNull(), "REMOVED").otherwise("MODIFIED")
    return both.select(op.alias("op"), "key", "old", "new")


def latest_rows(feed: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; on a stream the running ones."""
    row = F.struct(*[F.col(c) for c in feed.columns])
    return feed.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def latest_state(feed: DataFrame, key: str, order: str) -> DataFrame:
    """The table that a change feed (op, key, ...) leaves: the last row of each key, unless that removes it."""
    return latest_rows(feed, key, order).filter("op <> 'REMOVED'")


def continuous_top_k(stream: DataFrame, k: int, *cols: str) -> DataFrame:
    """Running top k words; complete mode."""
    return wordcount.word_count(stream, *cols).orderBy(F.desc("n"), F.asc("word")).limit(k)


class Plugin:
    """Override what is needed; each gets the rows of one micro-batch with that op."""

    def created(self, rows: DataFrame) -> None: ...

    def modified(self, rows: DataFrame) -> None: ...

    def removed(self, rows: DataFrame) -> None: ...


class Listeners:
    """Streams that are attached and can be stopped by name."""

    def __init__(self):
        self.queries: dict[str, StreamingQuery] = {}

    def attach(self, name: str, stream: DataFrame, each: Callable[[DataFrame, int], None] | Plugin, seconds: float | None = None) -> StreamingQuery:
        """Feed micro-batches to a function or plugin: every ``seconds``, else all that is there now."""

        def call(df: DataFrame, n: int) -> None:
            if not isinstance(each, Plugin):
                each(df, n)
                return
            for op, f in (("CREATED", each.created), ("MODIFIED", each.modified), ("REMOVED", each.removed)):
                f(df.filter(F.col("op") == op))

        writer = stream.writeStream.foreachBatch(call).option("checkpointLocation", f"{checkpoint_dir(stream.sparkSession)}/listen-{name}")
        writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
        self.queries[name] = writer.start()
        return self.queries[name]

    def detach(self, name: str) -> None:
        q = self.queries.pop(name)
        q.stop()
