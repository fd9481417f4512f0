"""Byte-level BPE encoding and decoding over a global dictionary of distinct words.

Pre-tokens of a text keep their positions as numbers in their chunk's list of distinct words. Each
distinct word is encoded in one place, the bucket of its hash; ids are joined back to the chunks and put in
the order of the positions. Decoding joins the table of token bytes to the ids, by id.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange
from quern.llm.exchange import Chunk, Numbering, expand, pack_ints, unpack_ints, unpack_words
from quern.llm.tokens import PART
from quern.llm.words import utf8
from quern.session import ship

KEPT_PARTS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _codec(path: str):
    """The merges of a rank file, and the bytes of its tokens end to end with their lengths."""
    import tiktoken

    ranks = read_ranks(path)
    merges = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    by_id = {i: b for b, i in ranks.items()}
    table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return merges, np.frombuffer(b"".join(table), np.uint8), np.array([len(b) for b in table], np.int64)


@functools.lru_cache(maxsize=2)
def _splitter(pattern: str) -> tuple:
    return regex.compile(pattern), {}


def pre_tokens(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the pre-tokens of all texts in order, how many each text has, and the pre-tokens by number.

    A text is first cut where white space follows another character. No match of the pattern spans
    such a place, nor looks past it, so a part gives the same matches alone; equal parts are matched once.
    """
    find, known = _splitter(pattern)
    if len(known) > KEPT_PARTS:
        known.clear()
    parts, words = Numbering(), Numbering()
    seqs = [np.fromiter(map(parts.__getitem__, p), np.int64, len(p)) for p in map(PART.findall, texts)]
    flat: list[int] = []
    lengths = np.empty(len(parts), np.int64)
    for n, part in enumerate(parts):
        found = known.get(part)
        if found is None:
            found = known[part] = find.findall(part)
        flat += map(words.__getitem__, found)
        lengths[n] = len(found)
    flat = np.array(flat, np.int64)
    which, n_parts = exchange.joined(seqs)
    ends = np.concatenate([[0], np.cumsum(lengths[which])])[np.concatenate([[0], np.cumsum(n_parts)])]
    return expand(flat, lengths, which), np.diff(ends), [utf8(w) for w in words]


def _encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and all ids."""
    merges = _codec(path)[0]
    ids = [merges._encode_single_piece(w) for w in words]
    return np.array([len(i) for i in ids], np.int64), np.array([x for i in ids for x in i], np.int64)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, and ``ids`` (integers) if asked for.

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes. A null
    text is empty: no tokens, hashes of nothing. Rows with equal or null ids each give a row; an empty table
    gives none. Special tokens are not recognised. ``path``, a rank file, is on every machine.
    """
    ship(docs.sparkSession)
    n = exchange.n_buckets(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind, id_type = docs.schema[id_col].dataType.simpleString(), exchange.arrow_type(docs, id_col)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        for ids, texts in exchange.runs(batches):
            yield Chunk(ids, texts, lambda t: pre_tokens(t, pattern))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            asked = list(c.questions(n))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in asked], pa.int64()), pa.array([c.key] * len(asked), pa.binary()), pa.array([x for _, x in asked], pa.binary())], ["bucket", "chunk", "words"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_words(pickle.loads(b)[0]) for b in table.column("words").to_pylist()]
        distinct = Numbering()
        own = [np.fromiter(map(distinct.__getitem__, w), np.int64, len(w)) for w in asked]
        lengths, flat = _encode_words(list(distinct), path)
        blobs = [pickle.dumps((pack_ints(lengths[o]), pack_ints(expand(flat, lengths, o)))) for o in own]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(blobs, pa.binary())], ["bucket", "chunk", "ids"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c.key], pa.binary()), pa.array([c.dumps()], pa.binary())], ["chunk", "texts"])

    def rejoin(texts: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist(), strict=True))
        out: list[tuple] = []
        _, token_bytes, token_lengths = _codec(path)
        for blob in texts.column("texts").to_pylist():
            c = Chunk.loads(blob)
            at = exchange.bucket_of(c.words, n)
            lengths, parts = np.zeros(len(c.words), np.int64), {}
            for b in np.unique(at).tolist():
                own = np.flatnonzero(at == b)
                if b in got:
                    of, flat = map(unpack_ints, pickle.loads(got[b]))
                    lengths[own], parts[b] = of.astype(np.int64), flat
                else:  # the input came in another order the second time, so this chunk has not asked
                    lengths[own], parts[b] = _encode_words([c.words[k] for k in own.tolist()], path)
            # from the order of buckets to the order of words
            order = np.argsort(at, kind="stable")
            flat = np.concatenate([parts[b] for b in sorted(parts)]).astype(np.int64) if parts else np.empty(0, np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ids = expand(flat, lengths[order], place[c.seq])
            n_ids = lengths[c.seq]
            data = expand(token_bytes, token_lengths, ids).tobytes()
            ends = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(c.lengths)])]
            byte_ends = np.concatenate([[0], np.cumsum(token_lengths[ids])])[ends]
            wide = ids.astype("<u4")
            for k, doc_id in enumerate(c.ids):
                own = wide[ends[k] : ends[k + 1]]
                out.append((doc_id, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(data[byte_ends[k] : byte_ends[k + 1]]).hexdigest(), own if keep_ids else None))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        cols = [pa.array([r[j] for r in out], t) for j, t in enumerate((None if out else pa.int64(), pa.int64(), pa.string(), pa.string()))]
        if keep_ids:
            names, cols = [*names, "ids"], [*cols, pa.array([r[4].astype(np.int32) for r in out], pa.list_(pa.int32()))]
        return pa.table(cols, names)

    answers = rows.mapInArrow(ask, "bucket long, chunk binary, words binary").groupBy("bucket").applyInArrow(answer, "bucket long, chunk binary, ids binary")
    texts = rows.mapInArrow(keep, "chunk binary, texts binary")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_with_type(rejoin, id_type), schema)


def _with_type(f, id_type: pa.DataType):
    """``f`` with its first column cast to ``id_type``; a column of nulls alone has no type."""

    def g(left: pa.Table, right: pa.Table) -> pa.Table:
        t = f(left, right)
        return t.set_column(0, "doc_id", t.column(0).cast(id_type))

    return g
