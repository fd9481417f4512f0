import pytest
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators.transform import transform
from quern.plans.job import configuration
from quern.sources import files


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo two\nthree\n")
    (tmp_path / "b.wiki").write_text(" doc id=1\nfirst line\nsecond\n doc\nnoise\n doc id=2\nx\n doc\n")
    return str(tmp_path)


def test_lines(spark, folder):
    assert [r["line"] for r in files.text_lines(spark, folder, "*.txt").collect()] == ["one", "two two", "three"]
    got = files.line_blocks(spark, folder + "/a.txt", 2).orderBy("block").collect()
    assert [r["lines"] for r in got] == [["one", "two two"], ["three"]]


def test_wiki(spark, folder):
    got = files.wiki_documents(spark, folder).orderBy("doc").collect()
    assert [r["text"] for r in got] == ["first line\nsecond", "x"]


def test_capped(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "i int, t string")
    assert files.capped(df, "t", 25, "i").count() == 3


def test_histograms(spark):
    df = spark.createDataFrame([(7, "a b a")], "doc_id long, text string")
    assert files.word_histograms(df, "doc_id", "text").first()["fields"] == {"a": 2.0, "b": 1.0, "~": 7.0}


def test_blobs(spark, tmp_path):
    store = files.BlobStore(spark, f"file://{tmp_path}/blobs")
    data = bytes(range(256)) * 20
    assert store.write_chunks("j", data, 1000) == 6
    assert store.read("j") == data and store.size("j") == len(data) and store.exists("j")
    store.download("j", str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == data
    assert store.delete("j") and not store.exists("j")


def test_save_and_show(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    files.save_map(df, "k", "v", str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ["\t a--->1", "\t b--->null"]
    assert "| NULL |" in files.pretty(df)


def test_urls(spark):
    df = spark.createDataFrame([(0, "com.example.www:http/a/b"), (1, "nothing"), (2, "a:b:c"), (3, "com.x:https")], "i int, uri string")
    got = [r["u"] for r in df.orderBy("i").select(scalar.restore_url(F.col("uri")).alias("u")).collect()]
    assert got == ["http://www.example.com/a/b", "", "", "https://x.com"]


def test_transform(spark):
    df = spark.createDataFrame([("t:1", "com.a.www:http/x", 0, 1), ("t:1", "com.b.www:http/y", 1000, 2), ("2", "bad", 5, 1)], "key string, pageuri string, ts long, seq int")
    got = {r["out_key"]: (r["pageuri"], r["ts"]) for r in transform(df, "key", "seq").collect()}
    assert got["1"] == ("http://www.b.com/y", "01/01/1970 00:00:01") and got["2"][1] == "01/01/1970 00:00:00"


def test_configuration(tmp_path):
    (tmp_path / "c.xml").write_text("<conf><k>2</k><nested><w>4</w></nested><empty/></conf>")
    assert configuration(str(tmp_path / "c.xml")) == {"k": "2", "w": "4"}


def test_maps(spark):
    df = spark.sql("SELECT map('a', 1.0D) AS x, map('a', 2.0D, 'b', 3.0D) AS y")
    assert df.select(scalar.merge_counts(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 3.0, "b": 3.0}
