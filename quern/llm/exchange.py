"""Chunks of texts as word numbers, and a global exchange of their distinct words.

A chunk is a run of rows of bounded size. It becomes one row: ids, lengths, and the texts as numbers
of the chunk's own list of distinct words, so positions cost a byte or two each. The distinct words of a
chunk go to buckets by their hash, packed into one row for each chunk and bucket. All rows of a bucket meet in
one group, which sees every word of its share of the dictionary and answers each chunk in the order of its
question. The number of buckets follows the size of the input, so a bucket's share does not grow with it.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 8 << 20
BUCKET_BYTES = 8 << 20


class Numbering(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, deflated."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(a).to_bytes(8, "little") + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_ints(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zlib.decompress(b[9:]), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_words(words: list[bytes]) -> bytes:
    return pickle.dumps((pack_ints(np.fromiter(map(len, words), np.int64, len(words))), zlib.compress(b"".join(words), 1)))


def unpack_words(b: bytes) -> list[bytes]:
    lengths, raw = pickle.loads(b)
    text = zlib.decompress(raw)
    ends = np.cumsum(unpack_ints(lengths)).tolist()
    starts = [0, *ends[:-1]] if ends else []
    return [text[a:e] for a, e in zip(starts, ends, strict=True)]


def joined(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and their lengths."""
    return np.concatenate([np.empty(0, np.int64), *seqs]), np.array([len(s) for s in seqs], np.int64)


def expand(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (run i has ``lengths[i]`` items) named by ``which``, end to end."""
    lengths = lengths.astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    n = lengths[which]
    total = int(n.sum())
    shift = np.repeat(starts[which] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(total)]


def arrow_type(docs: DataFrame, col: str) -> pa.DataType:
    """The Arrow type of a column; a column of nulls alone does not show it."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[col].dataType)


def bucket_of(words: list[bytes], n_buckets: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % n_buckets


def n_buckets(docs: DataFrame, text_col: str) -> int:
    """Buckets for about BUCKET_BYTES of text each, and no fewer than there are shuffle partitions."""
    size = docs.select(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def runs(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of rows(id, text) in runs of about ``limit`` characters."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            t = t.as_py() or ""
            if texts and size + len(t) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


class Chunk:
    """ids, number of words of each text, all word numbers in order, and the words, most frequent first."""

    def __init__(self, ids: list, texts: list[str], number: Callable[[list[str]], tuple[np.ndarray, np.ndarray, list[bytes]]]):
        """``number`` gives the word numbers of all texts end to end, how many each has, and the words."""
        digest = xxhash.xxh3_128()
        for i, t in zip(ids, texts, strict=True):
            digest.update(repr(i) + "\0")
            digest.update(t.encode("utf-8", "surrogatepass"))
        self.key, self.ids = digest.digest(), ids
        seq, self.lengths, words = number(texts)
        count = np.bincount(seq, minlength=len(words))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.seq, self.words = rank[seq], [words[k] for k in order.tolist()]

    def dumps(self) -> bytes:
        return pickle.dumps((self.ids, pack_ints(self.lengths), pack_ints(self.seq), pack_words(self.words)))

    @classmethod
    def loads(cls, blob: bytes) -> Chunk:
        new = cls.__new__(cls)
        new.ids, lengths, seq, words = pickle.loads(blob)
        new.lengths, new.seq, new.words = unpack_ints(lengths).astype(np.int64), unpack_ints(seq).astype(np.int64), unpack_words(words)
        return new

    def questions(self, n: int, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): the words of each bucket in the chunk's order, with their values."""
        at = bucket_of(self.words, n)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                yield int(at[own[0]]), pickle.dumps((pack_words([self.words[k] for k in own.tolist()]), *(pack_ints(v[own]) for v in values)))
