"""Checkpoints."""

import random

from quern.llm.components import components
from quern.session import cut


def _bits(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_of_checkpoints_do_not_grow_without_end(spark):
    df = cut(spark.range(7).selectExpr("id AS a", "id AS m"))
    for _ in range(9):  # the estimate is squared each time
        df = cut(df.join(df.withColumnRenamed("m", "n").hint("merge"), "a").select("a", "m"))
    assert _bits(df) <= 64
    assert sorted(map(tuple, df.collect())) == [(k, k) for k in range(7)]


def test_components_of_a_long_path(spark):
    order = list(range(1000))
    random.Random(3).shuffle(order)
    labels = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
    assert labels.count() == 1000
    assert labels.select("label").distinct().count() == 1
    assert _bits(labels) <= 64
