import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import by_key, rows
from ledgerloom.functions import status as st
from ledgerloom.plans import rollups
from market import Market


@pytest.fixture(scope="module")
def marts(spark):
    m = Market(spark)
    return {n: rollups.from_mart(getattr(m, n)).cache() for n in ("monthly", "category", "state", "payment")}


def cells(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("data,want", [
    ([(1, "observed"), (2, "observed")], ("ok", 3)), ([(1, "observed"), (2, "inferred")], ("inferred", 3)),
    ([(1, "inferred"), (None, "unavailable")], ("unavailable", None)), ([(None, "observed"), (None, "observed")], ("ok", None)),
    ([(None, "observed"), (4, "observed")], ("ok", 4)), ([(0, "observed")], ("ok", 0)),
])
def test_sum_status(spark, data, want):
    got = cells(spark, data, "v long, s string").agg(st.sum_field("v", "s").alias("t")).first()["t"]
    assert (got["status"], got["value"]) == want


STATES = ("ok", "inferred", "unavailable")


@pytest.mark.parametrize("a", STATES)
@pytest.mark.parametrize("b", STATES)
def test_rate_takes_the_weakest_status(spark, a, b):
    kind = "struct<status: string, value: bigint, nulls: bigint, reason: string>"
    df = cells(spark, [((a, 1 if a != "unavailable" else None, 0, None), (b, 4 if b != "unavailable" else None, 0, None))], f"n {kind}, d {kind}")
    got = df.select(st.rate("n", "d").alias("r")).first()["r"]
    assert got["status"] == max(a, b, key=STATES.index)
    assert got["value"] == (None if got["status"] == "unavailable" else 25.0)


def test_rate_without_denominator(spark):
    df = cells(spark, [(0, 0)], "n long, d long").agg(st.sum_field("n").alias("n"), st.sum_field("d").alias("d"))
    assert df.select(st.rate("n", "d").alias("r")).first()["r"]["reason"].startswith("nothing to divide by")


def test_combined_mean(spark):
    df = cells(spark, [(10.0, 5, 2.0), (40.0, 10, 4.0), (None, 0, None)], "s double, n long, m double")
    both = df.agg(st.combined_mean("s", "n", "m").alias("a"), st.combined_mean(None, None, "m").alias("b")).first()
    assert both["a"]["value"] == pytest.approx(50 / 15) and both["b"]["status"] == "unavailable"
    single = df.limit(1).agg(st.combined_mean(None, None, "m").alias("b"), st.single_cell_only("n").alias("c")).first()
    assert single["b"]["value"] == 2.0 and single["c"]["value"] == 5
    assert df.where("n = 0").agg(st.combined_mean("s", "n", "m").alias("a")).first()["a"]["status"] == "unavailable"


def test_weighted_is_not_the_mean_of_rates(spark):
    df = cells(spark, [("2017-01", 100, 50), ("2017-02", 900, 0)], "month_label string, delivered_orders long, late_orders long")
    got = df.agg(st.sum_field("late_orders").alias("l"), st.sum_field("delivered_orders").alias("d")).select(st.rate("l", "d").alias("r")).first()["r"]
    assert got["value"] == 5.0
    assert df.agg(F.avg(100.0 * F.col("late_orders") / F.col("delivered_orders"))).first()[0] == 25.0


def test_overview(marts):
    got = rows(rollups.overview(marts["monthly"], "2017-01", "2017-03"))[0]
    assert got["orders"]["value"] == 7 and got["gmv"]["value"] == 5930 + 12500 and got["gmv"]["nulls"] == 1
    assert got["late_rate"]["value"] == pytest.approx(20.0) and got["naive_late_mean"] == pytest.approx(100 / 6)
    assert got["aov"]["value"] == round(18430 / 6) and got["active_customers"]["status"] == "unavailable"
    only = rows(rollups.overview(marts["monthly"], "2017-03", "2017-03"))[0]
    assert only["gmv"]["value"] is None and only["aov"]["status"] == "unavailable" and only["active_customers"]["value"] == 1


def test_month_range_errors(marts):
    for kind in (ValueError, PySparkException, rollups.SelectionError):
        with pytest.raises(kind, match="after"):
            rollups.overview(marts["monthly"], "2017-03", "2017-01")
        with pytest.raises(kind, match="no data for an end of 2017-01..2031-01"):
            rollups.overview(marts["monthly"], "2017-01", "2031-01")


def test_series(marts):
    got = by_key(rollups.overview_series(marts["monthly"], "2017-01", "2017-03"), "month_label")
    assert got["2017-03"]["aov_c"] is None and got["2017-01"]["aov_c"] == 1977 and got["2017-03"]["late_rate"] is None


def test_categories(marts):
    view = rollups.categories(marts["category"], "2017-01", "2017-02")
    names = [r["product_category"] for r in view.rows.collect()]
    assert names[0] == "arte" and set(names) == {"arte", "house", "pet_shop", "unknown"}
    house = by_key(view.rows, "product_category")["house"]
    assert house["cells"] == 2 and house["customers"]["status"] == "unavailable" and house["orders"] == 3
    found = rollups.categories(marts["category"], "2017-01", "2017-02", search=" PET ")
    assert [r["product_category"] for r in found.rows.collect()] == ["pet_shop"]
    assert found.totals.first()["all_count"] == 4 and not found.totals.first()["no_match"]
    assert found.rows.first()["share_of_selected_gmv"]["den"] == 18430.0  # the whole selection stays the denominator
    assert rollups.categories(marts["category"], "2017-01", "2017-02", search="zzz").totals.first()["no_match"]
    by_name = rollups.categories(marts["category"], "2017-01", "2017-02", sort="name", top=2)
    assert [r["product_category"] for r in by_name.rows.collect()] == ["arte", "house"]


def test_states(marts):
    got = {r["customer_state"]: r for r in rollups.states(marts["state"], "2017-01", "2017-03").collect()}
    total = got[None]
    assert total["is_total"] and total["orders"] == 7 and total["late_rate"]["value"] == pytest.approx(20.0)
    assert got["RJ"]["late_rate"]["value"] == 100.0 and got["MG"]["late_rate"]["status"] == "unavailable"
    chosen = {r["customer_state"] for r in rollups.states(marts["state"], "2017-01", "2017-03", ["RJ"]).collect()}
    assert chosen == {"RJ", None}
    assert rollups.states(marts["state"], "2017-01", "2017-03", ["XX"]).count() == 0
    older = marts["state"].drop("late_orders", "delivered_orders", "delivery_days_sum", "delivery_days_n", "review_score_sum", "review_score_n")
    old = {r["customer_state"]: r for r in rollups.states(older, "2017-01", "2017-03").collect()}
    assert old["SP"]["late_rate"]["status"] == "unavailable" and old["RJ"]["late_rate"]["value"] == 100.0


def test_states_with_inferred_and_unavailable_cells(marts):
    marked = marts["state"].withColumn("orders_with_items_status", F.when(F.col("customer_state") == "RJ", "unavailable").otherwise("inferred"))
    got = {r["customer_state"]: r for r in rollups.states(marked, "2017-01", "2017-03").collect()}
    assert got["SP"]["aov"]["status"] == "inferred" and got["RJ"]["aov"]["status"] == "unavailable" and got[None]["aov"]["status"] == "unavailable"


def test_payments_keep_the_unfiltered_denominator(marts):
    got = by_key(rollups.payments(marts["payment"], "2017-01", "2017-02", ["boleto"]), "primary_payment_type")
    assert set(got) == {"boleto"} and got["boleto"]["share_of_orders"]["den"] == 5.0 and got["boleto"]["share_of_orders"]["value"] == 20.0


def test_decision_facts(marts):
    totals = rollups.decision_totals(marts["monthly"]).first()
    assert (totals["first_month"], totals["last_month"], totals["late_pct"]) == ("2017-01", "2017-03", 20.0)
    worst = [r["month_label"] for r in rollups.worst_months(marts["monthly"]).collect()]
    assert worst == ["2017-01", "2017-02"]
    ends = rollups.freight_extremes(marts["state"]).first()
    assert ends["lowest_customer_state"] == "MG" and ends["highest_customer_state"] == "SP"
