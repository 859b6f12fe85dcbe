"""A third of all rows on one key: results stay exact and no task has to hold that key whole."""

from pyspark.sql import functions as F

from conftest import by_key
from ledgerloom.operators.point_in_time import prior_and_full_counts
from ledgerloom.plans import facts, marts, order_grain

N = 30_000


def hot(i, size):
    """Key 0 for every third row."""
    return F.when(i % 3 == 0, 0).otherwise(i % size)


def exchange_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_payments_of_one_huge_order(spark):
    i = F.col("id")
    payments = spark.range(N).select(
        hot(i, 5000).alias("order_id"), (i % 2).cast("string").alias("payment_type"), F.lit(1).alias("payment_installments"),
        F.lit("1.00").cast("decimal(12,2)").alias("payment_value_brl"))
    out = order_grain.payments_agg(payments)
    got = by_key(out, "order_id")[0]
    want = payments.where("order_id = 0").count()
    assert got["payment_count"] == want and got["primary_payment_type"] in ("0", "1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.splitlines()[max(n for n, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line):]
    assert any("partial_sum" in line for line in first_exchange)  # rows collapse before they move


def test_account_with_a_third_of_all_orders(spark):
    i = F.col("id")
    enriched = spark.range(N).select(
        i.alias("order_id"), hot(i, 700).alias("customer_id"), F.timestamp_seconds(i * 3600).cast("timestamp_ntz").alias("purchased_at"),
        F.lit("2.00").cast("decimal(12,2)").alias("payment_total_brl"))
    customers = spark.range(700).select(
        F.col("id").alias("customer_id"), F.col("id").alias("customer_unique_id"), F.lit("s").alias("customer_state"),
        F.lit("c").alias("customer_city"), F.lit("z").alias("customer_zip_prefix"))
    got = by_key(facts.dim_customers(customers, enriched), "customer_unique_id")
    assert got[0]["order_count"] == enriched.where("customer_id = 0").count() and sum(v["order_count"] for v in got.values()) == N
    spread = marts.orders_per_person(enriched, customers)
    assert by_key(spread, "customer_unique_id")[0]["order_count"] == got[0]["order_count"]


def test_page_with_a_third_of_all_leads(spark):
    i = F.col("id")
    leads = spark.range(N).select(i.alias("mql_id"), F.concat(F.lit("p"), hot(i, 900)).alias("page"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 50).cast("int")).alias("day"))
    out = prior_and_full_counts(leads, "page", "day", "prior", "full")
    total = leads.where("page = 'p0'").count()
    worst = out.where("page = 'p0'").agg(F.max("full").alias("full"), F.max("prior").alias("prior")).first()
    last_day = leads.where("page = 'p0' and day = '2020-02-19'").count()
    assert worst["full"] == total and worst["prior"] == total - last_day


def test_zip_with_a_third_of_all_points(spark):
    i = F.col("id")
    points = spark.range(N).select(
        hot(i, 300).cast("string").alias("zip_prefix"), (i * 7919 % 100_003).cast("double").alias("latitude"), (-(i * 104_729 % 99_991)).cast("double").alias("longitude"),
        (i % 4).cast("string").alias("city"), F.lit("S").alias("state"))
    got = {r["zip_prefix"]: r for r in order_grain.zip_centroid(points).collect()}
    want = points.groupBy("zip_prefix").agg(F.median("latitude").alias("a"), F.median("longitude").alias("b"), F.count("*").alias("n"))
    for r in want.collect():
        assert (got[r["zip_prefix"]]["latitude"], got[r["zip_prefix"]]["longitude"], got[r["zip_prefix"]]["point_count"]) == (r["a"], r["b"], r["n"])
