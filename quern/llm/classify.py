"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one score, the sum of the weights of its hashed features; ordered thresholds on that score
give P(grade > k) = sigmoid(score - threshold k) for every k. All grades share the weights.

Features, each counted once for a text: its distinct words in lower case without outer punctuation;
and the share, in tenths, of shouted words, of words with symbols, and of distinct words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship

BITS = 18
MAX_RATED = 12_000  # rated texts that the model is fitted on, chosen by a hash of the id
MIN_TEXTS = 4  # a feature of fewer rated texts has no weight
ROUNDS = 150
KEPT_WORDS = 300_000
_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = set("#*$%&|<>")


class _Table(dict):
    """Word to 4 * hashed feature + shape (1 shouted, 2 with symbols); bounded, one for each worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        core = word.strip(_OUTER)
        shape = 2 if not _SYMBOLS.isdisjoint(word) else 1 if len(core) > 1 and core.isupper() else 0
        h = xxhash.xxh32_intdigest(core.lower().encode("utf-8", "surrogatepass")) >> (32 - BITS)
        out = self[word] = 4 * h + shape
        return out


_table = _Table()


def _tenth(name: str, part: float, whole: float) -> int:
    return xxhash.xxh32_intdigest(f"\0{name}{round(10 * part / max(whole, 1))}") >> (32 - BITS)


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a text."""
    counts = Counter(text.split())
    if not counts:
        return np.array([_tenth("empty", 0, 1)], np.int32)
    packed = np.fromiter(map(_table.__getitem__, counts), np.int64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    shape, total = packed & 3, int(times.sum())
    own = [_tenth("shout", times[shape == 1].sum(), total), _tenth("symbol", times[shape == 2].sum(), total), _tenth("distinct", len(counts), total)]
    return np.unique(np.concatenate([packed >> 2, own])).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # float32, 2 ** BITS
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def tails(self, found: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each text and each k."""
        if not found:
            return np.empty((0, len(self.thresholds)))
        flat = np.concatenate(found)
        starts = np.cumsum([0] + [len(x) for x in found[:-1]])
        score = np.add.reduceat(self.weights[flat].astype(np.float64), starts)
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(found: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, l2: float = 2e-4) -> Model:
    """Maximum likelihood with a penalty on squared weights, by Adam on all texts at once."""
    weights = np.zeros(1 << BITS)
    n = len(found)
    shares = np.array([(np.sum(grades > k) + 1) / (n + 2) for k in range(n_grades - 1)])
    first, gaps = -np.log(shares[0] / (1 - shares[0])), np.log(np.maximum(1e-2, np.diff(-np.log(shares / (1 - shares)))))
    if not n:
        return Model(weights.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))
    sizes = np.array([len(x) for x in found])
    flat, doc = np.concatenate(found), np.repeat(np.arange(n), sizes)
    common = np.bincount(flat, minlength=1 << BITS) >= MIN_TEXTS
    used = np.flatnonzero(common)
    place = np.zeros(1 << BITS, np.int64)
    place[used] = np.arange(len(used))
    keep = common[flat]
    col, doc = place[flat[keep]], doc[keep]
    params = np.concatenate([np.zeros(len(used)), [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = len(used)
    for step in range(1, rounds + 1):
        theta = params[k] + np.concatenate([[0.0], np.cumsum(np.exp(params[k + 1 :]))])
        score = np.bincount(doc, params[col], n) if len(col) else np.zeros(n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = _sigmoid(edges[grades] - score), _sigmoid(edges[grades + 1] - score)  # P(y < g), P(y <= g)
        p = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_score = (d_high - d_low) / p / n  # of the loss, -mean log p
        d_theta = np.array([np.sum(d_low[grades == j + 1] / p[grades == j + 1]) - np.sum(d_high[grades == j] / p[grades == j]) for j in range(n_grades - 1)]) / n
        grad = np.zeros_like(params)
        grad[:k] = (np.bincount(col, d_score[doc], k) if len(col) else 0) + l2 * params[:k] / max(1, n / 1000)
        grad[k] = d_theta.sum()
        grad[k + 1 :] = [d_theta[j + 1 :].sum() * np.exp(params[k + 1 + j]) for j in range(n_grades - 2)]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = params[:k]
    return Model(weights.astype(np.float32), params[k] + np.concatenate([[0.0], np.cumsum(np.exp(params[k + 1 :]))]))


def grade(quality_col: str = "quality", toxic_col: str = "toxic"):
    """Grades of the labels: 0 harmful, 1 poor, 2 good; null where a label is missing."""
    return F.when(F.col(toxic_col).isNull() | F.col(quality_col).isNull(), None).when(F.col(toxic_col) > 0, 0).otherwise(F.least(F.col(quality_col), F.lit(1)) + 1).cast("int")


def train(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3) -> Model:
    """Fit on at most ``max_rated`` rated texts. labels: id and an integer ``grade``; rows with a null there are not used."""
    ship(docs.sparkSession)
    rated = labels.select(F.col(f"`{id_col}`").alias("id"), "grade").dropna().orderBy(F.xxhash64("id"), "id", "grade").limit(max_rated)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(rated), "id").select("grade", "text", "id")  # at most max_rated rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "grade", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, grade int, f binary").collect()
    got.sort(key=lambda r: (r["id"], r["grade"], bytes(r["f"])))  # equal results whatever the order of arrival
    return fit([np.frombuffer(r["f"], np.int32) for r in got], np.array([r["grade"] for r in got], np.int64), n_grades)


def score(docs: DataFrame, model: Model, select: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, p_good, p_harmful, kept`` for each row.

    ``p_good``: P(highest grade); ``p_harmful``: P(lowest); ``kept``: p_good >= ``select``. A null text is
    scored as empty. Rows with equal or null ids each give a row.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = shared.value.tails([features(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(1 - tails[:, 0])], ["doc_id", "expected_grade", "p_good", "p_harmful"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, p_good double, p_harmful double").withColumn("kept", F.col("p_good") >= select)
