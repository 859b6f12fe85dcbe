import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from ledgerloom.operators.order_stats import ntile_column, ntile_columns, rows_at, running_sums, select_rows, top_n, with_position


@pytest.mark.parametrize("n,k", [(0, 5), (1, 5), (3, 5), (5, 5), (23, 5), (1000, 7)])
@pytest.mark.parametrize("nulls_first", [True, False])
def test_ntile_equals_the_window_function(spark, n, k, nulls_first):
    rng = random.Random(n * 10 + k)
    data = [(i, rng.choice([None, 1, 1, 1, 2, 3])) for i in range(n)]
    df = spark.createDataFrame(data, "id long, v int")
    order = F.asc_nulls_first("v") if nulls_first else F.asc_nulls_last("v")
    want = df.withColumn("w", F.ntile(k).over(Window.orderBy(order, "id")))
    got = want.withColumn("g", ntile_column(df, [("v", nulls_first), ("id", False)], k))
    assert got.where("w <> g").count() == 0 and got.count() == n


def test_ntile_splits_one_hot_value_by_id(spark):
    df = spark.range(0, 3000).withColumn("v", F.lit(7))
    sizes = df.groupBy(ntile_column(df, [("v", False), ("id", False)], 5).alias("b")).agg(F.count("*").alias("n"), F.max("id").alias("last"))
    assert [(r["n"], r["last"]) for r in sizes.orderBy("b").collect()] == [(600, 599), (600, 1199), (600, 1799), (600, 2399), (600, 2999)]


def test_positions_follow_the_order(spark):
    df = spark.range(0, 500).withColumn("v", F.col("id") % 10)
    got = with_position(df, [F.desc("v"), F.asc("id")])
    want = df.withColumn("w", F.row_number().over(Window.orderBy(F.desc("v"), "id")))
    assert got.join(want, "id").where("position <> w").count() == 0 and got.count() == 500


def test_rows_at_rejects_ranks_outside(spark):
    df = spark.range(0, 10)
    assert [r["id"] for r in rows_at(df, [("id", False, True)], [1, 10])] == [9, 0]
    with pytest.raises(ValueError):
        rows_at(df, [("id", False)], [11])


def test_running_sums(spark):
    df = spark.range(0, 1000).withColumn("n", F.col("id") % 3)
    got = running_sums(df, [F.asc("id")], ["n"])
    want = df.withColumn("w", F.sum("n").over(Window.orderBy("id")))
    assert got.join(want.select("id", "w"), "id").where("n_upto <> w").count() == 0 and got.count() == 1000


def test_top_n(spark):
    assert [r["id"] for r in rows(top_n(spark.range(50), [F.desc("id")], 3))] == [49, 48, 47]


ODD = [None, float("nan"), float("-inf"), -0.0, 1.5, 2.5, 2.5, 2.5]


@pytest.mark.parametrize("order", [[("v", True), ("id", False)], [("v", False, True), ("id", False)], [("s", False), ("v", True, True), ("id", True, True)]])
def test_selected_ranks_equal_the_sort(spark, order):
    """Small samples and ranked parts, so that brackets are narrowed, and some miss, again and again."""
    rng = random.Random(len(order))
    data = [(i, rng.choice(ODD), rng.choice([None, "a", "b", "é", "\U0001f600", "zz"])) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, v double, s string").repartition(5).cache()
    ranks = [1, 750, 1500, 2999]
    cols = [getattr(F, ("desc" if len(k) > 2 and k[2] else "asc") + ("_nulls_first" if k[1] else "_nulls_last"))(k[0]) for k in order]
    want = [r["id"] for r in df.orderBy(*cols).collect()]
    for sample, ranked in ((600, 200), (5000, 10)):
        found = select_rows(df, [(order, ranks), ([("id", False)], [3])], sample=sample, ranked=ranked)
        assert [found[0][r]["id"] for r in ranks] == [want[r - 1] for r in ranks] and found[1][3]["id"] == 2


def test_ranks_are_selected_without_moving_the_table(spark, monkeypatch):
    df = spark.range(0, 20_000).withColumn("v", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000))
    a, b = ntile_columns(df, [([("v", False), ("id", False)], 4), ([("id", False)], 5)], sample=2000, ranked=4000)
    got = df.select(a.alias("a"), b.alias("b"), F.ntile(4).over(Window.orderBy("v", "id")).alias("x"), F.ntile(5).over(Window.orderBy("id")).alias("y"))
    assert got.where("a <> x OR b <> y").count() == 0
    assert "Exchange" not in df.select(a, b)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_start_anew_for_each_key(spark, parts):
    """One key holds a third of the rows and spans partitions, others lie inside one, NULL is a key, sums may be negative."""
    df = spark.range(0, 3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 29)).alias("model"),
        (F.col("id") % 7).alias("segment"), (F.col("id") % 5 - 2).alias("n"), F.lit(1).alias("one"))
    want = df.withColumn("w", F.sum("n").over(Window.partitionBy("model", "segment").orderBy("id"))).withColumn("c", F.row_number().over(Window.partitionBy("model", "segment").orderBy("id")))
    got = running_sums(df, [F.asc("id")], ["n", "one"], parts, ["model", "segment"])
    both = got.join(want.select("id", "w", "c"), "id")
    assert both.count() == 3000 and both.where("n_upto <> w OR one_upto <> c").count() == 0
