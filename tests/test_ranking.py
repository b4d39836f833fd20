"""Numbering of groups cut into ranges."""

import random
import statistics

import pytest

from pyspark.sql import Window, functions as F

from docmarket.operators.ranking import order_ranges, rank_rows

ORDER = [("score", True), ("place", False), ("flag", True), ("key", False)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key in range(20_000):
        query = "hot" if key % 20 else rng.choice(["cold", "warm", None])
        score = rng.choice([None, float("nan"), -1.5, 0.0, 2.0, 7.25])
        data.append((query, score, rng.choice([None, "a", "é", ""]), rng.random() < 0.5, key))
    return spark.createDataFrame(data, "query_id string, score double, place string, flag boolean, key bigint").repartition(6).cache()


@pytest.mark.parametrize("per_range", [100, 999, 1_000_000])
def test_equals_a_plain_window(rows, per_range):
    columns = [F.desc(c) if d else F.asc(c) for c, d in ORDER]
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*columns)).cast("bigint"))
    got = rank_rows(rows, ["query_id"], ORDER, rows_per_range=per_range)
    assert got.columns == want.columns and got.count() == 20_000
    assert got.select("key", "rank").exceptAll(want.select("key", "rank")).count() == 0


def test_a_hot_query_is_spread(spark, rows):
    """95 % of the rows are one query's; no task gets more than twice the median."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = rank_rows(rows, ["query_id"], ORDER, rows_per_range=100)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("rank")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) <= 2 * statistics.median(sizes)


def test_ranges_are_in_order_and_of_like_size(rows):
    hot = rows.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 500")
    ranged, small = order_ranges(rows, ["query_id"], ORDER, hot, 500)
    sizes = [r["n"] for r in ranged.filter("query_id = 'hot'").groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert small and len(sizes) > 25 and max(sizes) < 3 * 500
    assert ranged.filter("query_id = 'cold' AND __range IS NOT NULL").count() == 0


def test_several_keys_repeats_and_no_rows(spark):
    same = spark.createDataFrame([("a", 1, 2.0, 5)] * 50 + [("a", None, 1.0, 5)] * 7, "x string, y int, s double, key int")
    got = rank_rows(same, ["x", "y"], [("s", True), ("key", False)], rows_per_range=10)
    assert sorted(r["rank"] for r in got.filter("y = 1").collect()) == list(range(1, 51))
    assert sorted(r["rank"] for r in got.filter("y IS NULL").collect()) == list(range(1, 8))
    assert rank_rows(same.limit(0), ["x", "y"], [("s", True)], rows_per_range=10).count() == 0
