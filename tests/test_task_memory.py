"""What one task holds must not grow with the tables."""

from pyspark.sql import functions as F

from ledgerloom.functions.measures import money_sum
from ledgerloom.operators.extracts import assemble
from ledgerloom.plans import marts
from ledgerloom.session import tasks_for
from workload import queries
from workload.world import WINDOW, World

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_tasks_follow_the_rows():
    assert [tasks_for(n, 10, 4) for n in (0, 40, 41, 1000)] == [4, 4, 5, 100]


def test_buckets_follow_the_lines(spark, monkeypatch):
    few = queries.QUERIES["stored_facts_join"](spark, SF)
    monkeypatch.setattr(queries, "BUCKET_ROWS", 500)
    many = queries.QUERIES["stored_facts_join"](spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert few.rdd.getNumPartitions() == queries.BUCKETS
    assert many.rdd.getNumPartitions() == -(-lines // 500) > queries.BUCKETS
    assert sorted(few.collect()) == sorted(many.collect())


def test_label_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(queries, "PAIR_ROWS", 100)
    lines = World(spark, SF).fct_lines
    dealt = queries.QUERIES["multi_category_orders"](spark, SF)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert f", {n})" in plan_of(dealt)
    assert sorted(dealt.collect()) == sorted(marts.multi_label_orders(lines).collect())


def test_category_mart_expands_no_line(spark):
    assert "Expand" not in plan_of(marts.category_performance(World(spark, SF).mart_lines, WINDOW))


def test_inferences_need_no_lines(spark, monkeypatch):
    whole = assemble(World(spark, SF).text_extracts(components=False)).inference_log.groupBy("extract", "field", "status").count()
    monkeypatch.setattr(World, "mart_lines", property(lambda w: (_ for _ in ()).throw(AssertionError("lines are written"))))
    alone = queries.QUERIES["inference_status_counts"](spark, SF)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.collect()))


def test_order_rows_are_not_expanded_to_grains(spark):
    """Only cells of all keys together are, and they give what each grain gives from the rows."""
    orders = World(spark, SF).mart_orders
    orders = orders.withColumn("customer_state", F.when(F.col("customer_state") != "n03", F.col("customer_state")))  # a NULL is a state of its own
    cells = marts.order_cells(orders)
    lines = [line.strip(" +-:*") for line in cells._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    below = lines[next(i for i, line in enumerate(lines) if line.startswith("Expand")) + 1:]
    assert below[0].startswith("Aggregate [purchase_month")
    for grain, keys in marts.GRAINS.items():
        alone = marts.order_cells(orders, [grain])
        assert [cells.schema[c].dataType for c in alone.columns] == [f.dataType for f in alone.schema.fields]
        got, meant = ([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect()]
                      for x in (cells.where(F.col("grain") == grain).select(*alone.columns), alone))
        assert sorted(got, key=str) == sorted(meant, key=str) and len(got) > 0


def test_instruments_of_an_order_collapse_once(spark):
    """Rows of (order, instrument) move to their order as they are: no partial aggregate sorts them ahead of that exchange."""
    plan = World(spark, SF).payments_agg._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = next(i for i, line in enumerate(plan) if "hashpartitioning(order_id" in line and "payment_type" not in line)
    assert not any("min_by" in line for line in plan[moved + 1:])


def test_money_sums_in_whole_cents(spark):
    """The same value and type as ``sum``, without a byte array for each row; odd amounts and a sum beyond 64 bits of cents included."""
    odd = ["0.01", "-0.01", "0.29", "-1.15", "9999999999.99", "-9999999999.99", "1234567890.12", None]
    df = spark.createDataFrame([(i % 3 if v else 9, v) for i, v in enumerate(odd * 3)], "k int, v string").select("k", F.col("v").cast("decimal(12,2)").alias("v"))
    huge = spark.range(1_000_000).select(F.lit(7).alias("k"), F.lit("99999999999.99").cast("decimal(13,2)").alias("v"))
    for x in (df, df.where("k = 9"), huge, df.select("k", F.col("v").cast("decimal(20,2)").alias("v")), df.select("k", F.col("v").cast("double").alias("v"))):
        ours, theirs = (x.groupBy("k").agg(s.alias("s")) for s in (money_sum(x, "v"), F.sum("v")))
        assert ours.schema == theirs.schema and sorted(ours.collect()) == sorted(theirs.collect())
    assert "sum(item_price_brl" not in plan_of(World(spark, SF).items_agg)
