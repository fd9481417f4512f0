"""Benchmark decontamination by winnowing.

A fingerprint is the smallest (last of equals) hash of k-grams in each window of consecutive k-grams.
With 5-grams and windows of 6 every shared run of 10 words holds a common fingerprint, at the same
place of the run in both texts. Joined fingerprints are extended to whole windows of 10 words, which
are compared word for word. Items of fewer than 10 words are one window of their own length and get
one fingerprint, the hash of that window; documents then also give hashes for these lengths.

The fingerprints of the benchmark go to every executor in slices of a bounded size. A benchmark of
more windows than one slice takes more passes over the documents, whose hits are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import balanced
from quern.llm.words import by_alnum, hash_words, shingle_hashes
from quern.session import ship

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1  # k-grams in a window of words
SLICE_WORDS = 2_000_000  # words of the benchmark that one pass carries: at most about 100 MB on a worker


def winnow(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the fingerprints: the last smallest hash of every ``span`` consecutive ones."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = grams[:n].copy()
    at = np.arange(n)
    for i in range(1, span):
        later = grams[i : i + n]
        take = later <= best
        best[take] = later[take]
        at[take] = np.flatnonzero(take) + i
    return np.unique(at)


class Benchmark:
    """Items as words, and their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: list[list[bytes]] = []
        self.ids: list[int] = []
        self.by_print: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = by_alnum(text)
            if not words:
                continue
            k = len(self.words)
            self.words.append(words)
            self.ids.append(item_id)
            h = hash_words(words)
            if len(words) < WINDOW:
                self.short[len(words)][int(shingle_hashes(h, len(words))[0])].append(k)
            else:
                grams = shingle_hashes(h, GRAM)
                for at in winnow(grams).tolist():
                    self.by_print[int(grams[at])].append((k, at))
        self.known = _Sieve(self.by_print)
        self.known_short = {n: _Sieve(x) for n, x in self.short.items()}

    def hits(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: number of words, spans of words in windows found, items with a window found.

        The texts are joined for the arithmetic. That adds fingerprints across their borders, which the
        comparison of words drops, and takes none away.
        """
        words = [by_alnum(t) for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        h = hash_words([w for own in words for w in own])
        spans: list[set[tuple[int, int]]] = [set() for _ in texts]
        items: list[set[int]] = [set() for _ in texts]

        def places(at: np.ndarray):
            own = np.searchsorted(begin, at, "right") - 1
            return zip(own.tolist(), (at - begin[own]).tolist(), at.tolist(), strict=True)

        grams = shingle_hashes(h, GRAM)
        prints = winnow(grams)
        for d, at, g in places(prints[self.known.may(grams[prints])]):
            own = words[d]
            for k, off in self.by_print.get(int(grams[g]), ()):
                item = self.words[k]
                # the run of equal words around the fingerprint, no farther than a window reaches
                left = 0
                while left < SPAN - 1 and at > left and off > left and own[at - left - 1] == item[off - left - 1]:
                    left += 1
                right, most = 0, min(len(own) - at, len(item) - off, WINDOW)
                while right < most and own[at + right] == item[off + right]:
                    right += 1
                if right >= GRAM and left + right >= WINDOW:
                    spans[d].add((at - left, at + right))
                    items[d].add(self.ids[k])
        for n, sieve in self.known_short.items():
            grams = shingle_hashes(h, n)
            for d, at, g in places(np.flatnonzero(sieve.may(grams))):
                for k in self.short[n].get(int(grams[g]), ()):
                    if words[d][at : at + n] == self.words[k]:
                        spans[d].add((at, at + n))
                        items[d].add(self.ids[k])
        return [(len(w), merge(s), i) for w, s, i in zip(words, spans, items, strict=True)]


class _Sieve:
    """A bitmap of hashes by their top bits: false says that a hash is not there."""

    BITS = 22

    def __init__(self, hashes):
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[np.array(list(hashes), np.uint64) >> np.uint64(64 - self.BITS)] = True

    def may(self, h: np.ndarray) -> np.ndarray:
        return self.map[h >> np.uint64(64 - self.BITS)]


def merge(spans) -> list[tuple[int, int]]:
    """Sorted spans without overlap that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Words, spans and items for each row of docs(key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    state: list[Benchmark] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Benchmark(shared.value))
        for b in batches:
            found = [x for run in balanced(b.column(1).to_pylist(), 4 << 20) for x in state[0].hits(run)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"a": a, "b": e} for a, e in f[1]] for f in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([sorted(map(str, f[2])) for f in found], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<a: long, b: long>>, items array<string>")


def slices(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items that have words, in runs of about ``limit`` words, read one partition at a time."""
    run, size = [], 0
    for row in benchmark.select(F.col(f"`{item_col}`"), F.col(f"`{text_col}`")).filter(F.col(f"`{text_col}`").isNotNull()).toLocalIterator():
        n = len(by_alnum(row[1]))
        if run and size + n > limit:
            yield run
            run, size = [], 0
        if n:
            run.append((row[0], row[1]))
            size += n
    if run:
        yield run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """``doc_id, n_words, spans, items`` for each row of ``docs``: merged spans of hit words, and ids of items found, sorted as strings.

    A null text has no words. Rows with equal ids each give a row. An empty benchmark hits nothing. Only
    the named columns are read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    runs = slices(benchmark, item_col, item_text, slice_words)
    first = next(runs, [])
    second = next(runs, None)
    if second is None:
        return _scan(rows, first)
    # more passes: rows that are equal in id and text have equal hits, so one of them stands for all
    keyed = rows.groupBy("doc_id", "text").count()
    key = F.struct("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"), "count")
    keyed = keyed.select(key.alias("doc_id"), "text")
    parts = [_scan(keyed, first), _scan(keyed, second), *(_scan(keyed, r) for r in runs)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr("""
        aggregate(all, CAST(array() AS array<struct<a: bigint, b: bigint>>), (m, s) ->
            CASE WHEN size(m) > 0 AND s.a <= element_at(m, -1).b
                 THEN concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a AS a, greatest(element_at(m, -1).b, s.b) AS b)))
                 ELSE concat(m, array(s)) END)""")
    found = found.select("doc_id", "n_words", merged.alias("spans"), "items")
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("doc_id.count").cast("int")))).select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The result of ``find`` as counts and a hash of the items."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns."""
    ship(docs.sparkSession)
    runs = slices(benchmark, "item_id", "text", SLICE_WORDS)
    out = docs
    for items in runs:
        out = _without(out, items, text_col)
    return out


def _without(docs: DataFrame, items: list[tuple[int, str]], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    state: list[Benchmark] = []
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Benchmark(shared.value))
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([not x[1] for run in balanced(texts, 4 << 20) for x in state[0].hits(run)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
