"""Map-reduce jobs with user functions.

A job's mapper is a generator over (key, value row) and emits (key, value); reducers are generators over (key,
iterator of values) and emit (key, value). Keys are text; values are JSON-like. A combiner runs inside each map
task, also over what it has emitted itself, a local reducer once for each site and key, the reducer once for each
key. Built-in jobs are plain DataFrame functions chosen by name; a known name always wins over user functions.
"""

from __future__ import annotations

import json
import time
import uuid
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum
from itertools import chain, groupby, islice
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators import countmin, kmeans, wordcount
from quern.session import checkpoint_dir, ship

Emit = Iterator[tuple[str, Any]]
BUFFER = 100_000  # values that a map task holds before it combines
FEW = 4  # values of a key that are left apart until they go out
HELD = 800_000  # values that it keeps to combine with later ones
HELD_BYTES = 32_000_000  # and their size as JSON, by some of them


class State(Enum):
    PENDING = "PENDING"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"


@dataclass
class Job:
    name: str
    inputs: list[str]
    output: str
    builtin: str = ""
    mapper: Callable[[str, dict], Emit] | None = None
    combiner: Callable[[str, Iterator], Emit] | None = None
    local_reducer: Callable[[str, Iterator], Emit] | None = None
    reducer: Callable[[str, Iterator], Emit] | None = None
    configuration: dict = field(default_factory=dict)
    scheduling: list[str] = field(default_factory=list)  # input sites; none: all
    key: str = "key"
    site: str | None = None  # column of the site
    modules: list[str] = field(default_factory=list)  # files with user functions' code, sent to the executors
    on_error: str = "fail"  # or "skip": records that raise are left out and counted


def configuration(path: str) -> dict[str, str]:
    """Leaves of an XML file as a flat dictionary."""
    out = {}
    for e in ET.parse(path).getroot().iter():
        if not len(e) and e.text and e.text.strip():
            out[e.tag] = e.text.strip()
    return out


def map_stage(df: DataFrame, job: Job) -> DataFrame:
    """``site, key, value`` (JSON) of all emitted pairs, combined within tasks where there is a combiner."""
    ship(df.sparkSession)
    mapper, combiner, key, skip = job.mapper, job.combiner, job.key, job.on_error == "skip"
    errors = df.sparkSession.sparkContext.accumulator(0)
    job.configuration["errors"] = errors
    site = F.col(job.site).cast("string") if job.site else F.lit("")
    src = df.select(site.alias("site"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, list]] = {}  # values by site and key
        size, limit = 0, BUFFER  # values held, and how many may be before they are combined

        def combine() -> int:
            """Combine the keys that have more than a few values; returns how many values are held then."""
            left = 0
            for of in held.values():
                again = [p for k in [k for k, vs in of.items() if len(vs) > FEW] for p in combiner(k, iter(of.pop(k)))]
                left += sum(map(len, of.values())) + len(again)
                for k, v in again:
                    of[k if type(k) is str else str(k)].append(v)
            return left

        def large(left: int) -> bool:
            """Whether what is held goes out, by number or by the size of some of it."""
            some = list(islice(((k, v) for of in held.values() for k, vs in of.items() for v in vs), 100))
            return left >= HELD or left * sum(len(k) + len(_dump(v)) for k, v in some) >= HELD_BYTES * len(some)

        def flush() -> Iterator[pa.RecordBatch]:
            sites, keys, values = [], [], []
            for s, of in held.items():
                while of:
                    k, vs = of.popitem()
                    for k2, v2 in combiner(k, iter(vs)) if combiner else ((k, v) for v in vs):
                        sites.append(s)
                        keys.append(str(k2))
                        values.append(_dump(v2))
                    if len(keys) >= 10_000:
                        yield _batch(("site", "key", "value"), (sites, keys, values))
                        sites, keys, values = [], [], []
            if keys:
                yield _batch(("site", "key", "value"), (sites, keys, values))

        for batch in batches:
            for s, k, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    pairs = list(mapper(k, json.loads(row)))
                except Exception:
                    if not skip:
                        raise
                    errors.add(1)
                    continue
                of = held.get(s)
                if of is None:
                    of = held[s] = defaultdict(list)
                for k2, v2 in pairs:
                    of[k2 if type(k2) is str else str(k2)].append(v2)
                size += len(pairs)
                if size >= limit:
                    size = combine() if combiner else size
                    if not combiner or large(size):
                        yield from flush()
                        size = 0
                    limit = size + max(BUFFER, min(size, HELD // 2))
        yield from flush()

    return src.mapInArrow(run, "site string, key string, value string")


def _dump(v: Any) -> str:
    return str(v) if type(v) is int else json.dumps(v)


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, list]]:
    """``keys, values`` of each run of rows with the same keys; values are the last column."""
    n, *keys, values = b.num_rows, *b.columns
    try:
        values = values.cast(pa.int64()).to_pylist()  # JSON texts that are all whole numbers
    except pa.ArrowInvalid:
        values = list(map(json.loads, values.to_pylist()))
    new = np.arange(n) == 0
    for c in keys:
        for x in (c.is_null(), c.fill_null("")):
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    heads = zip(*(c.take(pa.array(at)).to_pylist() for c in keys), strict=True)
    for head, a, z in zip(heads, at.tolist(), [*at[1:].tolist(), n], strict=True):
        yield head, values[a:z]


def _batch(names: tuple[str, ...], columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], list(names))


def _reduce(pairs: DataFrame, reducer: Callable, by: list[str]) -> DataFrame:
    """Run a reducer over each key. Rows of a key come sorted together and are streamed to it, so no group is held in memory."""

    names = (*by[:-1], "key", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for keys, parts in groupby((r for b in batches for r in _runs(b)), key=itemgetter(0)):
            for k, v in reducer(keys[-1], chain.from_iterable(map(itemgetter(1), parts))):
                out.append((*keys[:-1], str(k), _dump(v)))
            if len(out) >= 10_000:
                yield _batch(names, tuple(zip(*out)))
                out = []
        if out:
            yield _batch(names, tuple(zip(*out)))

    schema = ", ".join(f"{c} string" for c in names)
    return pairs.select(*by, "value").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def local_stage(df: DataFrame, job: Job) -> DataFrame:
    """``key, value`` (JSON text) of the sites that the job names, mapped, combined and reduced by site."""
    if job.scheduling and job.site:
        df = df.filter(F.col(job.site).cast("string").isin(job.scheduling))
    pairs = map_stage(df, job)
    if job.local_reducer:
        pairs = _reduce(pairs, job.local_reducer, ["site", "key"])
    return pairs.select("key", "value")


def reduce_stage(pairs: DataFrame, job: Job) -> DataFrame:
    """``key, value`` that the reducer emits; without a reducer the pairs themselves."""
    return _reduce(pairs, job.reducer, ["key"]) if job.reducer else pairs


def run_generic(df: DataFrame, job: Job) -> DataFrame:
    """``key, value`` (JSON text) that the reducer emits; without a reducer, what was emitted before it."""
    return reduce_stage(local_stage(df, job), job)


def _word_count(df: DataFrame, conf: dict) -> DataFrame:
    return wordcount.word_count(df, *conf.get("columns", ["text"]))


def _count_min(df: DataFrame, conf: dict) -> DataFrame:
    w, d = conf.get("w", 4), conf.get("d", 4)
    cells = countmin.cells(df, w, d, *conf.get("columns", ["text"]))
    return countmin.rows(cells, w) if conf.get("reduceLocal") else cells


def _k_means(df: DataFrame, conf: dict) -> DataFrame:
    vectors = kmeans.Bags(df, conf.get("id", "doc_id"), conf.get("column", "text"))
    assigned, _ = kmeans.fit(vectors, conf.get("k", 2), conf.get("iterations", 1), conf.get("id", "doc_id"))
    return assigned


BUILTIN = {"wordCount": _word_count, "countMin": _count_min, "kMeans": _k_means}


class Engine:
    """Runs jobs over the views of a session and keeps their states."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.states: dict[str, tuple[State, str]] = {}
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}  # of results

    def submit(self, job: Job) -> str:
        """Run a job, and make its result, written beside the checkpoints, the temp view ``job.output``; returns its id.

        The state is COMPLETED when the result is there; a failure, also of a user function, is kept as the state.
        """
        job_id = uuid.uuid4().hex
        began = time.time()
        self.states[job_id] = (State.RUNNING, "")
        try:
            for path in job.modules:
                self.spark.sparkContext.addPyFile(path)
            df = self.spark.table(job.inputs[0])
            for name in job.inputs[1:]:
                df = df.unionByName(self.spark.table(name))
            known = BUILTIN.get(job.builtin) or BUILTIN.get(job.name)
            out = known(df, job.configuration) if known else run_generic(df, job)
            folder = f"{checkpoint_dir(self.spark)}/job-{job_id}"
            rows = Observation(f"job-{job_id}")
            out.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
            self.spark.read.schema(out.schema).parquet(folder).createOrReplaceTempView(job.output)
            self.rows[job_id] = rows.get["rows"]
            self.states[job_id] = (State.COMPLETED, "")
        except Exception as e:
            self.states[job_id] = (State.FAILED, str(e))
        self.seconds[job_id] = time.time() - began
        return job_id

    def progress(self) -> dict[str, float]:
        """Done share of the tasks of each stage that runs now, for another thread to ask while ``submit`` works."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return {i.name: i.numCompletedTasks / max(1, i.numTasks) for i in infos if i}

    def status(self, job_id: str) -> tuple[State, str]:
        return self.states.get(job_id, (State.PENDING, "NON-EXISTENT"))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def workflow(self, df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    def create(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
