"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, places where the tokenizer always starts a new piece, so that the
sum of the lengths of the parts is the length of the whole. Distinct parts of a byte-balanced batch
are encoded once, and lengths of parts seen before are kept in a bounded table of each worker.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship

# The characters of Unicode's White_Space property, as in the tokenizer's \s.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PART = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

BATCH_BYTES = 4 << 20
KEPT_PARTS = 400_000


def _safe(path: str) -> bool:
    """Whether a text may be cut where white space follows another character.

    True for byte-level BPE with the usual pattern: none of its matches has white space after another
    character. Special strings must not hold white space, or strip it.
    """
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
    return bool(plain and not odd and spec.get("normalizer") is None and not spec.get("post_processor"))


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t, _safe(path), {}


@functools.lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def balanced(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def lengths(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """The number of tokens of each text."""
    if path.endswith(".model"):
        sp = _pieces(path)
        return [len(ids) for run in balanced(texts, batch_bytes) for ids in sp.encode(run, num_threads=1)]
    tokenizer, safe, known = _tokenizer(path)
    out: list[int] = []
    for run in balanced(texts, batch_bytes):
        if not safe:
            out += map(len, tokenizer.encode_batch_fast(run, add_special_tokens=False))
            continue
        parts = [PART.findall(text) for text in run]
        fresh = set().union(*parts).difference(known)
        if len(known) + len(fresh) > KEPT_PARTS:
            known.clear()
            fresh = set().union(*parts)
        for some in balanced(sorted(fresh), 1 << 18):
            known.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        out += [sum(map(known.__getitem__, p)) for p in parts]
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); rows with equal or null ids each give a row; an
    empty table gives none; other columns are not read. ``path``: a tokenizers ``.json`` or a
    sentencepiece ``.model`` file that every machine has at that place.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(lengths(b.column(1).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
