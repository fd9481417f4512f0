import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe, idfile, rangecoder, tokens


def test_counts(docs, rows, same, empty):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    expected = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 1024))
    same(tokens.count_tokens(docs, path).collect(), expected)
    assert tokens.count_tokens(empty, path).count() == 0


def test_counts_of_pieces():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    texts = ["Hello you", "", "é" * 50]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokens.lengths(texts, path) == [len(sp.encode(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x1c\x85　ab'sS.!<|>endoftextÉé1²"), max_size=60))
def test_cuts_are_safe(text):
    path = P.path("byte_bpe_50k.json")
    assert tokens.lengths([text], path) == [len(tokens._tokenizer(path)[0].encode(text, add_special_tokens=False).ids)]
    words = idfile._words(P.path("word_bpe_49k.json"))
    got, n = words.encode([text], 2)
    assert got.tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 2] and n.tolist() == [len(got)]


def test_bpe(docs, rows, same, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = []
    for i, text in rows:
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same(bpe.encode(docs, path, P.PATTERN).collect(), expected)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 5000, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 49408, np.zeros(n, np.int64), np.full(n, 49407), rng.integers(0, 49408, n)):
        assert (rangecoder.decode(rangecoder.encode(ids, 49408)) == ids).all()


def test_coder_shrinks_and_detects_damage():
    ids = np.tile(np.arange(500), 200)
    (block,) = rangecoder.encode(ids, 49408)
    assert len(block) < len(ids)
    for at in (30, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(bad))


def test_id_files(docs, rows, spark, same, empty):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = idfile.scratch(spark)
    idfile.write(docs, path, out)
    expected, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same(idfile.read(spark, out).collect(), expected)
    out = idfile.scratch(spark)
    idfile.write(empty, path, out)
    assert idfile.read(spark, out).count() == 0


def test_ids_of_all_types(spark):
    """Ids are handed through, whatever their type, and kept ids are those that are hashed."""
    from quern.llm import jaccard

    path = P.path("byte_bpe_multi_50k.tiktoken")
    for sql in ("CAST(id AS DATE)", "CAST(id AS TIMESTAMP)", "CAST(id AS DECIMAL(20, 2))", "CAST(1 AS FLOAT)", "CAST('a' AS BINARY)", "true"):
        value = sql.replace("CAST(id AS", "CAST('2020-02-02' AS" if "DATE" in sql or "TIME" in sql else "CAST(7 AS")
        df = spark.sql(f"SELECT {value} AS `my.id`, 'one two three four five six' AS `my.text` UNION ALL SELECT NULL, NULL")
        got = bpe.encode(df, path, P.PATTERN, "my.id", "my.text", keep_ids=True).collect()
        assert sorted(len(r["ids"]) for r in got) == sorted(r["n_tokens"] for r in got) and {r["doc_id"] for r in got} == {r[0] for r in df.collect()}
        assert all(hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in got)
        assert {r["doc_id"] for r in jaccard.join(df, id_col="my.id", text_col="my.text").collect()} == {r[0] for r in df.collect()}
        assert tokens.count_tokens(df, P.path("byte_bpe_50k.json"), id_col="my.id", text_col="my.text").count() == 2


def test_texts_of_several_chunks(spark, same, monkeypatch):
    """Chunks, runs and blocks smaller than the texts, so that all meet."""
    from quern.llm import exchange

    rng = np.random.default_rng(5)
    texts = ["", None, "x" * 3000] + [" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (1, 50, 400, 2000, 7, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    expected = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    words = idfile._words(path)
    got, n = [], []
    for _, run in exchange.runs(iter(df.toArrow().to_batches()), 1000):
        ids, lengths = words.encode(run, 2)
        monkeypatch.setattr(rangecoder, "BLOCK", 500)
        got += rangecoder.decode(rangecoder.encode(ids, words.size)).tolist()
        n += lengths.tolist()
    assert got == [x for e in expected for x in e] and n == list(map(len, expected))


def test_known_pieces_stay_between_calls(monkeypatch):
    monkeypatch.setattr(idfile, "KEPT_WORDS", 6)
    words = idfile.Words(P.path("word_bpe_49k.json"))
    for k, text in enumerate(["aa bb cc dd", "cc dd ee", "É日本 ff gg", "aa hh", "hh"]):
        got, n = words.encode([text, text], 2)
        assert got.tolist() == 2 * [*words.tokenizer.encode(text, add_special_tokens=False).ids, 2] and n.tolist() == 2 * [len(got) // 2]
        assert k != 1 or "aa" in words.pieces  # known ones do not count twice


def test_places_are_looked_up_in_order(monkeypatch):
    """Decoding asks for ids that are not guessed in order of their shares, to 16 bits, and gives what was coded."""
    ids = np.minimum(np.random.default_rng(5).geometric(0.002, 300_000), 4999)
    blocks = rangecoder.encode(ids, 5000)
    seen, find = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda cum, x, side: seen.append(x >> max(0, int(cum[-1]).bit_length() - 16)) or find(cum, x, side))
    assert (rangecoder.decode(blocks) == ids).all()
    assert any(len(x) > 100 for x in seen) and all((np.diff(x) >= 0).all() for x in seen)


def test_pieces_of_plain_texts_are_looked_up_once():
    """Texts of a run are cut together, as the library cuts them, and each distinct piece of the run is looked up once."""
    rng = np.random.default_rng(7)
    parts = ["'", "'", "''", "s", "T", "re", "VE", "l", "ll", "m", "d", "x", "Éa", "ÿ", "ß", "1", "23", " ", " ", "\t\n", "\x0b", "!", "-.", "\x00", "\x7f"]
    texts = ["", "'", "x'", "don't'", "'re", " 'l", "É日本'S", *("".join(rng.choice(parts, n)) for n in (1, 5, 60, 2000, 3, 400))]
    words = idfile.Words(P.path("word_bpe_49k.json"))
    asked = []

    class Seen(type(words.pieces)):
        def __getitem__(self, name):
            asked.append(name)
            return super().__getitem__(name)

    words.pieces = Seen(words.pieces)
    expected = [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    got, n = words.encode(texts, 2)
    assert got.tolist() == [x for e in expected for x in e] and n.tolist() == list(map(len, expected))
    assert len(asked) == len(set(asked)) > 20
    assert words.encode([""], 2)[0].tolist() == [2]
