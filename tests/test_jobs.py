import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quern.operators import countmin, kmeans, relational, special, wordcount
from quern.plans import predicates
from quern.plans.job import Engine, Job, State, run_generic
from quern.streaming import continuous
from quern import tables


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


def words(key, row):
    for w in (row["text"] or "").split(" "):
        if w:
            yield w, 1


def add(key, values):
    yield key, sum(values)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "a b  a ", 0), (2, None, 0), (3, "", 1), (4, " b c", 1), (5, "a a a", 2)], "key int, text string, site int")


def counts(df):
    return {r[0]: int(r[1]) for r in df.collect()}


EXPECTED = {"a": 5, "b": 2, "c": 1}


@pytest.mark.parametrize("combiner", [None, add])
@pytest.mark.parametrize("local", [None, add])
def test_generic_gives_the_same_whatever_the_stages(texts, combiner, local):
    job = Job("w", [], "o", mapper=words, combiner=combiner, local_reducer=local, reducer=add, site="site")
    assert counts(run_generic(texts, job)) == EXPECTED
    assert counts(wordcount.word_count(texts, "text")) == EXPECTED
    assert counts(wordcount.word_count_two_level(texts, F.col("site"), "text")) == EXPECTED


def test_sites_and_errors(spark, texts):
    job = Job("w", [], "o", mapper=words, reducer=add, site="site", scheduling=["0", "1"])
    assert counts(run_generic(texts, job)) == {"a": 2, "b": 2, "c": 1}

    def bad(key, row):
        if row.get("text") is None:
            raise ValueError("no text")
        yield from words(key, row)

    job = Job("w", [], "o", mapper=bad, reducer=add, on_error="skip")
    assert counts(run_generic(texts, job)) == EXPECTED
    with pytest.raises(Exception, match="no text"):
        run_generic(texts, Job("w", [], "o", mapper=bad, reducer=add)).collect()


def test_engine(spark, texts):
    e = Engine(spark)
    e.create("texts", texts)
    job = e.submit(Job("any", ["texts"], "out", builtin="wordCount"))
    assert e.status(job)[0] is State.COMPLETED and counts(e.sql("SELECT * FROM out")) == EXPECTED
    assert e.status("x") == (State.PENDING, "NON-EXISTENT")
    assert e.status(e.submit(Job("any", ["nowhere"], "out2", builtin="wordCount")))[0] is State.FAILED
    e.drop("texts")


def test_sketch(spark, texts):
    assert countmin.sizes() == (4, 4)
    for w in (4, 7):
        cells = countmin.cells(texts, w, 4, "text")
        assert {r["s"] for r in cells.groupBy("row").agg(F.sum("n").alias("s")).collect()} == {8}
        probes = spark.createDataFrame([("a",), ("zz",)], "word string")
        got = {r["word"]: r["estimate"] for r in countmin.estimate(cells, probes, w, 4).collect()}
        assert got["a"] >= 5 and got["zz"] >= 0


def test_sketch_hash_is_javas(spark):
    names = ["a", "hello", "Straße", "", "zzzzzzzzzzzz"]
    jvm = spark._jvm
    df = spark.createDataFrame([(n,) for n in names if n], "word string")
    for w in (4, 7, 1000):
        got = {(r["word"], r["row"]): r["col"] for r in countmin.with_cells(df, w, 3).collect()}
        for n in filter(None, names):
            random = jvm.java.util.Random(_java_hash(n))
            assert [got[n, i] for i in range(3)] == [random.nextInt(w) for _ in range(3)]


def _java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_kmeans_rules(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "c d"), (3, "a"), (4, "zz"), (5, "c c c")], "doc_id long, text string")
    v = wordcount.histogram(docs, "doc_id", "text")
    assigned, centroids = kmeans.fit(v, 2, 5)
    got = {r["doc_id"]: r["cluster"] for r in assigned.collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    assert {r["cluster"]: r["ids"] for r in kmeans.members(assigned).collect()} == {0: "1 3 4", 1: "2 5"}


def test_predicate_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "")], "i int, t string")
    f = lambda n: {"type": "FIELD", "body": {"column": n}}
    c = lambda v: {"type": "CONST", "body": {"datum": v}}
    two = lambda k, a, b: {"type": k, "body": {"leftExpr": a, "rightExpr": b}}
    ids = lambda t: sorted(r["i"] for r in predicates.filter_rows(df, t).collect())
    assert ids({"type": "IS_NULL", "body": {"leftExpr": f("t")}}) == [1]
    assert ids(two("EQUAL", f("t"), c("x"))) == [2]
    assert ids({"type": "NOT", "body": {"expr": two("EQUAL", f("t"), c("x"))}}) == [3]
    assert ids(two("LIKE", f("t"), c("_"))) == [2]
    tree = two("AND", two("EQUAL", f("db.p.url"), f("db.e.page")), two("EQUAL", f("db.e.s"), f("db.p.s")))
    assert predicates.fields_by_table(tree) == {"db.p": ["url", "s"], "db.e": ["page", "s"]}
    assert predicates.join_keys(tree, "db.p", "db.e") == [("url", "page"), ("s", "s")]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, tables.put(t, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, tables.put_if_absent(t, new.filter("v <> 'd'"), "k").collect())) == [(1, "a"), (2, "b"), (3, "e")]
    assert tables.batch_get(t, "k", 2, -1).count() == 1 and tables.contains(t, "k", 1) and not tables.contains(t, "k", 9)
    assert relational.page(t, 1, 5, ("k", True)).count() == 1
    assert relational.key_range(t, "v", 0, 1).count() == 0


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = special.reach(edges, spark.createDataFrame([("a",)], "node string"), 4)
    assert {r["node"]: r["level"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_count_window(spark, tmp_path):
    rows = [(i, f"k{i % 4}", float(i), "REMOVED" if i % 7 == 6 else "MODIFIED", "g") for i in range(40)] + [(99, "", 0.0, "FLUSH", "g")]
    spark.createDataFrame(rows, "seq long, key string, value double, op string, g string").coalesce(1).write.parquet(str(tmp_path / "feed"))
    out = continuous.finish(continuous.count_window(continuous.source(spark, str(tmp_path / "feed")), "g", "key", "value", 3), "append")
    got = sorted((r["window"], r["keys"], r["total"]) for r in out.collect())
    assert got == continuous.count_windows_of([(k, v, op) for _, k, v, op, _ in rows], 3)


def test_change_feed(spark):
    rows = [(1, "CREATED", "a", 1), (2, "MODIFIED", "a", 2), (3, "CREATED", "b", 5), (4, "REMOVED", "b", 5)]
    df = spark.createDataFrame(rows, "seq int, op string, key string, v int")
    assert [(r["key"], r["v"]) for r in continuous.latest_state(df, "key", "seq").collect()] == [("a", 2)]


def test_listeners(spark, tmp_path):
    spark.createDataFrame([(1, "CREATED"), (2, "REMOVED")], "k int, op string").write.parquet(str(tmp_path / "feed"))
    seen = []

    class P(continuous.Plugin):
        def created(self, rows):
            seen.extend(r["k"] for r in rows.collect())

    hub = continuous.Listeners()
    hub.attach(f"p{tmp_path.name}", continuous.source(spark, str(tmp_path / "feed")), P()).awaitTermination()
    hub.detach(f"p{tmp_path.name}")
    assert seen == [1]


def test_count_windows_flush_and_keep_order(spark, tmp_path):
    rows = [(i, f"k{i % 5}", float(i), "REMOVED" if i % 11 == 10 else "MODIFIED", "gh"[i % 3 == 0]) for i in range(200)]
    feed = spark.createDataFrame(rows, "seq long, key string, value double, op string, g string").coalesce(1)
    for k in range(4):  # four micro-batches, each of later rows in any order
        feed.filter(f"seq DIV 50 = {k}").orderBy(F.desc("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    got = continuous.CountWindows(continuous.source(spark, str(tmp_path / "feed"), 1), "g", "key", "value", 3).finish()
    for g in "gh":
        expected = continuous.count_windows_of([(k, v, op) for _, k, v, op, x in rows if x == g] + [("", 0.0, "FLUSH")], 3)
        assert sorted((r["window"], r["keys"], r["total"]) for r in got.filter(F.col("group") == g).collect()) == expected


def test_windows_by_name(spark, tmp_path):
    rows = [(i, f"k{i}", float(i), "g") for i in range(6)]
    spark.createDataFrame(rows, "seq long, key string, value double, g string").coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = lambda: continuous.source(spark, str(tmp_path / "feed"))
    run = lambda conf: sorted((r["window"], r["keys"], r["total"]) for r in continuous.finish(continuous.windowed(feed(), "g", "key", "value", conf), "append").collect())
    assert run({"window": "sizeBased", "windowSize": "2"}) == [(0, 2, 1.0), (1, 2, 5.0), (2, 2, 9.0)]
    assert run({}) == [(i, 1, float(i)) for i in range(6)]
    assert run({"window": "timeBased", "windowSize": "0"}) == [(0, 6, 15.0)]


def test_continuous_jobs_give_the_batch_result(spark, texts, tmp_path):
    for r in texts.collect():
        spark.createDataFrame([r], texts.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = continuous.source(spark, str(tmp_path / "feed"), 1)
    job = Job("w", [], "o", mapper=words, combiner=add, local_reducer=add, reducer=add, site="site")
    run = continuous.map_reduce(feed, job)
    assert counts(run.finish()) == EXPECTED and run.progress() == {"batches": 5, "rows": 5}
    seeds = spark.createDataFrame([(0, "a", 1.0), (1, "c", 1.0)], "cluster int, word string, value double")
    got = {(r["cluster"], r["word"]): r["total"] for r in continuous.k_means_sums(feed, seeds, "key").finish().collect()}
    assert got == {(0, "a"): 5, (0, "b"): 1, (0, None): 2, (1, "b"): 1, (1, "c"): 1, (1, None): 1}
    top = continuous.finish(continuous.continuous_top_k(feed, 1, "text")).collect()
    assert [tuple(r) for r in top] == [("a", 5)]


def test_changes_between_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    got = {r["key"]: (r["op"], r["old"] and r["old"]["v"], r["new"] and r["new"]["v"]) for r in continuous.changes(old, new, "k").collect()}
    assert got == {1: ("REMOVED", "a", None), 2: ("MODIFIED", "b", "c"), 4: ("CREATED", None, "d")}


def test_engine_states_are_honest(spark, texts, tmp_path):
    (tmp_path / "user_words.py").write_text("def upper(key, row):\n    for w in (row['text'] or '').split():\n        yield w.upper(), 1\n")
    sys.path.insert(0, str(tmp_path))
    import user_words

    e = Engine(spark)
    e.create("texts2", texts)
    job = e.submit(Job("w", ["texts2"], "out3", mapper=user_words.upper, reducer=add, modules=[str(tmp_path / "user_words.py")]))
    assert e.status(job)[0] is State.COMPLETED and counts(e.sql("SELECT * FROM out3")) == {"A": 5, "B": 2, "C": 1} and e.rows[job] == 3

    def bad(key, row):
        raise ValueError("not today")

    state, why = e.status(e.submit(Job("w", ["texts2"], "out4", mapper=bad, reducer=add)))
    assert state is State.FAILED and "not today" in why and e.progress() == {}
    steps = (lambda d: d.filter("site = 0"), lambda d: d.select("key"))
    assert sorted(r["key"] for r in e.workflow(texts, *steps).collect()) == [1, 2]


def test_sketch_hash_beyond_the_basic_plane_and_second_draws(spark):
    names = ["\U0001f600", "a\U0001f600b", "é\U00010000"]
    df = spark.createDataFrame([(n,) for n in names], "word string")
    w = (1 << 30) + 1  # draws again in about half of all cases
    got = {(r["word"], r["row"]): r["col"] for r in countmin.with_cells(df, w, 2).collect()}
    units = {n: [int.from_bytes(n.encode("utf-16-be")[i : i + 2], "big") for i in range(0, len(n.encode("utf-16-be")), 2)] for n in names}
    for n in names:
        h = _java_hash("".join(map(chr, units[n])))
        bits = spark._jvm.java.util.Random(h)
        for i in range(2):
            draws = []
            for _ in range(3):  # as many as are looked at
                draws.append(bits.nextInt(1 << 30) * 2)  # 30 of its 31 bits
                if draws[-1] - draws[-1] % w + w - 1 < 1 << 31:
                    break
            assert got[n, i] // 2 * 2 in (draws[-1] % w // 2 * 2, draws[-1] % w) or len(draws) == 3


def test_default_tables(spark, sf):
    tables.register(spark, sf, "region", "nation")
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25
