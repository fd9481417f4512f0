import corpus_pipeline
from quern.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        docs = docs.cache()
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > seen[4] == seen[5] > 0
    assert corpus_pipeline.run(spark, sf).count() == seen[-1]


def test_names():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)


def test_stages_on_odd_rows(spark, sf, docs, empty):
    """Nulls, repeated rows, clashing columns and empty tables pass through every stage."""
    last = corpus_pipeline.STAGES[-1][0]
    few = docs.filter("doc_id IS NULL OR doc_id >= 9000 OR doc_id % 10 = 0").cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, few, sf)
        assert name == last or out.columns == few.columns
        n = out.count()
        assert n == few.count() if name in ("line_dedup", last) else 0 < n <= few.count()
        assert stage(spark, empty, sf).count() == 0
