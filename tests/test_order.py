import math

import pytest
from pyspark.sql import functions as F

from tarazu.functions import order


@pytest.mark.parametrize("n", [0, 1, 7, 99, 100, 500])
def test_sample_has_exact_size_and_prefix_order(spark, n):
    df = spark.range(100).withColumnRenamed("id", "row_id").repartition(7)
    got = {r[0] for r in order.sample(df, n, 42, "row_id").collect()}
    wanted = [r[0] for r in order.hash_order(df, 42, "row_id").limit(n).collect()] if n else []
    assert got == set(wanted) and len(got) == min(n, 100)


@pytest.mark.parametrize("n, share", [(0, 0.05), (1, 0.05), (20, 0.05), (21, 0.05), (1000, 0.1)])
def test_split_sizes(spark, n, share):
    kept, held = order.split_exact(spark.range(n).withColumnRenamed("id", "row_id"), share, 1, "row_id")
    assert held.count() == math.ceil(n * share) and kept.count() == n - math.ceil(n * share)


def test_upper_ranks(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 11)] + [(None,)], "v int")
    r = order.upper_ranks(df, "v", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).first()
    assert (r.n, r["min"], r["max"], r["mean"], r.median, r.p90, r.p95, r.p99) == (10, 1, 10, 5, 6, 10, 10, 10)
    assert tuple(order.upper_ranks(df.limit(0), "v", {"median": 0.5}).first()) == (0, 0, 0, 0, 0)
    assert order.upper_ranks(df.limit(0).withColumn("g", F.lit(1)), "v", {"median": 0.5}, ["g"]).count() == 0


def test_positions_are_dense_with_ties_in_the_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), "id").repartition(9)
    got = order.with_position(df, "a", "id").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000))
    assert [(r.a, r.id) for r in got] == sorted((i % 3, i) for i in range(1000))
    assert [r.batch for r in order.batches(df, 300, "a", "id").orderBy("pos").collect()][::300] == [0, 1, 2, 3]


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 4900, "big").when(F.col("id") < 4990, "small").alias("label"))
    got = order.bounded_sample(df, 50, 3, "row_id", "label")
    assert sorted(r.label for r in got) == ["big"] * 50 + ["small"] * 50
    again = order.bounded_sample(df.repartition(13), 50, 3, "row_id", "label")
    assert {r.row_id for r in got} == {r.row_id for r in again}
    assert len(order.bounded_sample(df, 6000, 3, "row_id")) == 5000
    assert order.bounded_sample(df.limit(0), 5, 3, "row_id") == []
    assert order.bounded_sample(df.where("label is null"), 5, 3, "row_id", "label") == []
