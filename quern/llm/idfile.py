"""Token ids of documents in files of range-coded blocks, in ascending order of the document ids.

A file is a Parquet table whose rows are runs: the ids and token counts of some documents in a row, and
their tokens as independent, checksummed blocks (see ``rangecoder``). Runs are numbered within their shard, and
shards follow the order of the document ids, so any run can be read, checked and made again alone.
Parquet is the container so that Spark writes and reads the files in any store, commits them whole, and
writes a lost task's file again.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import exchange, rangecoder
from quern.llm.exchange import Numbering, expand
from quern.llm.tokens import WHITE_SPACE, balanced
from quern.session import checkpoint_dir, ship

RUN_CHARS = 6 << 20
SHARD_BYTES = 12 << 20
KEPT_WORDS = 300_000
_BETWEEN = re.compile(f"[^{WHITE_SPACE}]+")
# In texts of ASCII and the letters of Latin-1 it is known what the tokenizer's classes are: white space, letters, digits, others.
_OTHER_THAN_PLAIN = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]|<\\|")
_SPACE, _LETTER, _DIGIT, _REST = range(4)
_KIND = np.full(256, _REST, np.uint8)  # of each character in lower case
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    out, n = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


_LETTERS = _byte_letters()


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of plain texts in order, as Latin-1, and how many each text has: runs of letters, an apostrophe with
    s, t, re, ve, m, ll or d, single digits, and runs of others but white space."""
    data = np.frombuffer("\n".join([*texts, "\n\n"]).lower().encode("latin-1"), np.uint8)
    kind = _KIND[data]
    begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _DIGIT)
    at = np.flatnonzero((data == ord("'")) & begins)
    if len(at):
        one = np.isin(data[at + 1], np.frombuffer(b"stmd", np.uint8))
        two = np.isin(data[at + 1] * np.uint16(256) + data[at + 2], np.frombuffer(b"revell", ">u2"))
        begins[at[one | two] + 1] = False
        begins[at[one] + 2] = True
        begins[at[two] + 3] = True
    held = kind != _SPACE
    data, at = data[held], np.flatnonzero(begins & held)
    offsets = np.append(np.flatnonzero(begins[held]), len(data)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces, np.diff(np.searchsorted(at, ends), prepend=0)


class Words:
    """Ids of words by a tokenizers file that drops white space; a bounded table of each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self._forget()
        with open(path) as f:
            spec = json.load(f)
        pattern = json.dumps((spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern"))
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        # whether words may be encoded apart: white space is dropped, and no special string holds any
        self.apart = steps == ["NFC", "Replace", "Lowercase"] and "\\\\p{L}]+|[\\\\p{N}]|[^\\\\s" in pattern and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        self.size = self.tokenizer.get_vocab_size()

    def _forget(self) -> None:
        """An empty table: piece 0 is the end, whose id each call sets."""
        self.pieces = Numbering({"": 0})
        self.lengths, self.flat = np.ones(1, np.int64), np.zeros(1, np.int64)

    def _numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the pieces of plain texts. Each distinct piece of all is looked up once; new ones have no ids yet."""
        if not texts:
            return []
        found, n = _cut(texts)
        found = found.dictionary_encode()
        _, ends, letters = found.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64, len(found.dictionary) + 1).tolist()
        letters = letters.to_pybytes().decode("latin-1")
        names = [letters[a:e] for a, e in pairwise(ends)]
        fresh = [x for x in names if x not in self.pieces]
        self.pieces.update(zip(fresh, range(len(self.pieces), len(self.pieces) + len(fresh)), strict=True))
        own = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))
        return np.split(own[found.indices.to_numpy()], np.cumsum(n)[:-1])

    def _of_pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of plain pieces, each one pre-token in lower case, by the library's model."""
        names = [x if x.isascii() and x.isalnum() else "".join(map(_LETTERS.__getitem__, x.encode())) for x in names]
        return _joined([*map(self.tokenizer.model.tokenize, names)], attrgetter("id"))

    def _of_words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of other words by the library as a whole."""
        return _joined([e.ids for some in balanced(names, 1 << 18) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)], int)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, and how many each has."""
        if not self.apart:
            ids = [[*e.ids, end] for run in balanced(texts, 1 << 22) for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            return np.array([x for i in ids for x in i], np.int64), np.array([len(i) for i in ids], np.int64)
        # pieces keep their numbers from call to call; a call that failed may have left some without ids
        if len(self.pieces) > KEPT_WORDS or len(self.pieces) != len(self.lengths):
            self._forget()
        pieces, words = self.pieces, Numbering()  # words count from -1 down
        plain = [_is_plain(text) for text in texts]
        numbers = iter(self._numbers([t for t, p in zip(texts, plain, strict=True) if p]))
        seqs = []
        for text, p in zip(texts, plain, strict=True):
            if p:
                seq = next(numbers)
            else:
                names = _BETWEEN.findall(text)
                seq = -1 - np.fromiter(map(words.__getitem__, names), np.int64, len(names))
            seqs.append(np.append(seq, 0))
        self.lengths, self.flat = _extended(self.lengths, self.flat, *self._of_pieces(list(islice(pieces, len(self.lengths), None))))
        self.flat[0] = end
        lengths, flat = _extended(self.lengths, self.flat, *self._of_words([*words]))
        which = np.concatenate(seqs)
        which[which < 0] = len(pieces) - 1 - which[which < 0]
        n = lengths[which]
        cuts = np.cumsum([len(s) for s in seqs])
        return expand(flat, lengths, which), np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], cuts])])


def _joined(lists: list[list], number: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists, and the numbers of their items end to end."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return n, np.fromiter(map(number, chain.from_iterable(lists)), np.int64, int(n.sum()))


def _extended(lengths: np.ndarray, flat: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``lengths`` and ``flat`` with ``more`` lists of ``ids`` after them."""
    return np.concatenate([lengths, more]), np.concatenate([flat, ids])


def _is_plain(text: str) -> bool:
    """No characters but ASCII and letters of Latin-1, and no special string."""
    if text.isascii():
        return not ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not _OTHER_THAN_PLAIN.search(text)


@functools.lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def write(docs: DataFrame, path: str, out: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text (null: empty) and write the ids, ``end`` after each text, to files in folder ``out``.

    Rows with equal ids stay beside each other, ordered by text; rows without id come first.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = rows.select(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        words = _words(path)
        for seq, (ids, texts) in enumerate(exchange.runs(batches, RUN_CHARS)):
            tokens, lengths = words.encode(texts, end)
            blocks = rangecoder.encode(tokens, words.size)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "seq": [seq], "n_tokens": [len(tokens)], "doc_ids": [ids], "lengths": [lengths], "blocks": [blocks]}, schema)

    sql = f"shard int, seq int, n_tokens long, doc_ids array<{kind}>, lengths array<long>, blocks array<binary>"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], sql).schema)
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, sql).write.option("compression", "none").mode("errorifexists").parquet(out)


def read(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files, and ``ids`` if asked for; checksums are verified."""
    ship(spark)
    files = spark.read.parquet(out)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                col = {n: b.column(n)[k] for n in ("shard", "seq", "doc_ids", "lengths", "blocks")}
                tokens = rangecoder.decode([x.as_py() for x in col["blocks"].values])
                lengths = col["lengths"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                parts = [tokens[a:e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(parts)
                cols = [pa.array([col["shard"].as_py()] * n, pa.int32()), pa.array([col["seq"].as_py()] * n, pa.int32()), col["doc_ids"].values, pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<long>" if keep_ids else ""
    rows = files.select("shard", "seq", "doc_ids", "lengths", "blocks").mapInArrow(run, f"shard int, seq int, doc_id {kind}, at long, n_tokens long, ids_crc32 long{more}")
    runs = files.select("shard", "seq", "n_tokens")
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("in_shard"))
    # one row for each shard, so one task is enough to add them up
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = runs.join(totals, "shard").select("shard", "seq", (F.col("in_shard") + F.col("before")).alias("offset"))
    cols = ["doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.join(offsets, ["shard", "seq"]).select(*cols)


def scratch(spark: SparkSession) -> str:
    """A new folder for files, beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
