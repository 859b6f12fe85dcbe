from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import by_key, rows
from ledgerloom.operators import grain
from ledgerloom.plans import marts
from ledgerloom.sources.schemas import GRAIN, ORDER_STATUSES, PAYMENT_TYPES, REVIEW_SCORES
from ledgerloom.functions.measures import in_half_open
from market import CUSTOMERS, ITEMS, ORDERS, PAYMENTS, REVIEWS, WINDOW, Market


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark)


def source_checks(s):
    """The checks every build runs on its sources."""
    out = {}
    for role, keys in GRAIN.items():
        if role in s:
            out[f"{role}: key"] = grain.unique_combination(s[role], keys)
            out[f"{role}: key not null"] = grain.not_null(s[role], keys)
    out["status"] = grain.accepted_values(s["orders"], "order_status", ORDER_STATUSES)
    out["instrument"] = grain.accepted_values(s["order_payments"], "payment_type", PAYMENT_TYPES)
    out["score"] = grain.accepted_values(s["order_reviews"], "review_score", REVIEW_SCORES)
    for child in ("order_items", "order_payments", "order_reviews"):
        out[f"{child}: order exists"] = grain.relationships(s[child], "order_id", s["orders"], "order_id")
    out["customer exists"] = grain.relationships(s["orders"], "customer_id", s["customers"], "customer_id")
    return out


def model_checks(m):
    return {
        "spine rows": grain.equal_rowcount(m.staged["orders"], m.enriched).where("not holds"),
        "order key": grain.unique(m.fct_orders, "order_id"),
        "money": grain.money_survives([(m.staged["order_items"], [("item_total_brl", "items_total_brl")]),
                                       (m.staged["order_payments"], [("payment_value_brl", "payment_total_brl")])], m.enriched).where("not holds"),
        "facts": grain.facts_agree(m.fct_orders, m.fct_lines).where("not holds"),
        "marts": grain.metric_layer_reconciles(marts.order_cells(m.fct_orders), m.fct_lines, m.monthly, m.category, m.state, m.payment,
                                               in_half_open("purchased_at", *WINDOW)).where("not holds"),
        "components": grain.additive_components_agree(marts.order_cells(m.fct_orders), m.monthly, m.state, m.payment).where("not holds"),
        "recency": grain.recency_anchor(m.people),
    }


def test_everything_holds_on_the_market(market):
    grain.require(source_checks(market.staged))
    grain.require(model_checks(market))


@pytest.mark.parametrize("table,data,broken", [
    ("orders", ORDERS + [ORDERS[0]], "orders: key"),
    ("order_items", ITEMS + [("o01", 1, "p9", "s1", None, 1, 1)], "order_items: key"),
    ("orders", [(ORDERS[0][0], ORDERS[0][1], "teleported", *ORDERS[0][3:]), *ORDERS[1:]], "status"),
    ("order_payments", PAYMENTS + [("o99", 1, "boleto", 1, 5)], "order_payments: order exists"),
    ("order_reviews", REVIEWS + [("r9", "o06", 7, None, None, None, None)], "score"),
    ("customers", CUSTOMERS[1:], "customer exists"),
])
def test_injected_source_defects_are_caught(spark, table, data, broken):
    checks = source_checks(Market(spark, **{table: data}).staged)
    with pytest.raises(grain.ContractBroken, match=broken):
        grain.require({broken: checks[broken]})


def test_model_defects_are_caught(spark, market):
    late = market.fct_orders.withColumn("is_delivered_late", F.col("is_delivered_late") | (F.col("order_id") == "o04"))
    broken = grain.additive_components_agree(marts.order_cells(late), market.monthly, market.state, market.payment).where("not holds")
    assert [r["check_name"] for r in broken.collect()] == ["late implies delivered"]
    lost = market.fct_lines.where("order_id <> 'o06'")
    assert {r["check_name"] for r in grain.facts_agree(market.fct_orders, lost).where("not holds").collect()} == {"same item money", "same orders with items"}
    doubled = market.state.union(market.state.limit(1))
    names = {r["check_name"] for r in grain.metric_layer_reconciles(
        marts.order_cells(market.fct_orders), market.fct_lines, market.monthly, market.category, doubled, market.payment, in_half_open("purchased_at", *WINDOW)).where("not holds").collect()}
    assert names and names <= {"state gmv", "state orders"}
    gone = market.payment.where("month_label <> '2017-01'")
    assert [r["month_label"] for r in grain.payment_scope_by_month(market.monthly, gone).collect()] == ["2017-01"]


def test_probe_finds_the_grain(market):
    got = by_key(grain.probe_grain(market.staged["order_reviews"], [["review_id"], ["order_id"], ["review_id", "order_id"]]), "candidate_key")
    assert [got[k]["is_key"] for k in ("review_id", "order_id", "review_id, order_id")] == [False, False, True]
    assert got["review_id"]["excess_rows"] == 1


def test_fanout_report_equals_the_real_join(market):
    s = market.staged
    got = by_key(grain.fanout_report(s["orders"], {"items": s["order_items"], "pay": s["order_payments"], "rev": s["order_reviews"]}, "order_id",
                                     {"items": "item_total_brl", "pay": "payment_value_brl"}), "measure")
    joined = s["orders"].join(s["order_items"], "order_id").join(s["order_payments"], "order_id").join(s["order_reviews"], "order_id")
    real = joined.agg(F.count("*").alias("n"), F.sum("item_total_brl").alias("i"), F.sum("payment_value_brl").alias("p"), F.countDistinct("order_id").alias("k")).first()
    assert got["items"]["joined_rows"] == real["n"] and got["items"]["joined_total"] == real["i"] and got["pay"]["joined_total"] == real["p"]
    assert got["items"]["parent_keys_lost"] == 9 - real["k"] and got["items"]["inflation"] > 1


def test_missing_children_and_coverage(spark, market):
    s = market.staged
    got = by_key(grain.missing_children(s["orders"], "order_id", {"items": s["order_items"], "pay": s["order_payments"]}), "child_table")
    assert got["items"]["parents_without_child"] == 1 and got["pay"]["parents_without_child"] == 2 and got["pay"]["orphan_rows"] == 0
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k int")
    assert rows(grain.join_coverage(left, right, "k"))[0] == {
        "left_rows": 4, "left_keys": 2, "right_rows": 4, "right_keys": 2, "matched_right_rows": 1, "matched_keys": 1, "matched_pct": 50.0}


def test_month_checks(spark):
    months = spark.sql("select explode(array(date'2017-01-01', date'2017-02-01', date'2017-04-01')) as purchase_month")
    assert rows(grain.contiguous_months(months))[0] == {"months": 3, "month_span": 4}
    gap = rows(grain.month_gaps(months))[0]
    assert (gap["before_month"].month, gap["after_month"].month) == (2, 4)
    assert grain.contiguous_months(months.limit(2)).count() == 0


def test_row_rules_and_buckets(spark):
    df = spark.createDataFrame([(1, 5, 3), (2, 1, 1), (3, None, 1)], "id int, a int, b int")
    broken = rows(grain.row_rules(df, {"a <= b": F.col("a") <= F.col("b")}, ["id"]))
    assert broken == [{"id": 1, "broken_rule": "a <= b"}]
    five = spark.range(23).withColumn("b", F.ntile(5).over(Window.orderBy("id")))
    assert grain.buckets_even(five, "b", 5).count() == 0 and grain.buckets_even(five, "b", 4).count() == 1
    assert grain.buckets_even(five.where("b > 1"), "b", 5).count() == 1


def test_expectations_report_both_directions(spark):
    actual = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n int")
    pinned = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("c", None)], "k string, n int")
    got = {r["k"]: r["problem"] for r in grain.expect(actual, pinned, ["k"]).collect()}
    assert got == {"b": "differs", "d": "missing"}
    one = spark.createDataFrame([(9, Decimal("1.50"))], "orders long, gmv decimal(10,2)")
    assert grain.expect_values(spark, one, {"orders": 9, "gmv": "1.50"}).count() == 0
    assert [r["metric"] for r in grain.expect_values(spark, one, {"orders": 8}).collect()] == ["orders"]
