import datetime as dt
from decimal import Decimal

import pytest

from conftest import by_key, rows
from ledgerloom.operators.median import exact_medians
from ledgerloom.plans import facts, marts, order_grain, segments
from market import WINDOW, Market


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark)


def test_zip_keeps_leading_zeros_and_state_is_upper(market):
    staged = by_key(market.staged["customers"], "customer_id")
    assert staged["a1"]["customer_zip_prefix"] == "01001" and staged["a1"]["customer_state"] == "SP"


def test_items_collapse_to_order_grain(market):
    got = by_key(market.items, "order_id")
    assert (got["o01"]["item_count"], got["o01"]["distinct_sellers"], got["o01"]["distinct_products"]) == (3, 2, 2)
    assert got["o01"]["items_total_brl"] == Decimal("43.30") and "o05" not in got


def test_primary_payment_by_value_then_name(market):
    got = by_key(market.payments, "order_id")
    assert got["o01"]["primary_payment_type"] == "credit_card"  # 21.65 each
    assert got["o03"]["primary_payment_type"] == "voucher"  # 3 + 3 beats 4
    assert (got["o03"]["payment_count"], got["o03"]["distinct_payment_types"], got["o03"]["max_installments"]) == (3, 2, 2)
    assert got["o04"]["payment_total_brl"] == Decimal("0.00")


def test_latest_review_prefers_answered_then_recent(market):
    got = by_key(market.reviews, "order_id")
    assert (got["o01"]["latest_review_score"], got["o01"]["avg_review_score"], got["o01"]["review_count"]) == (1, 3.0, 2)
    assert got["o02"]["latest_review_score"] == 4


def test_centroid_is_median_and_modal_label_breaks_ties_by_name(market):
    got = by_key(market.centroid, "zip_prefix")["01001"]
    assert got["latitude"] == pytest.approx(-23.55) and got["longitude"] == pytest.approx(-46.45)
    assert got["city"] == "sao paulo" and got["point_count"] == 4


def test_spine_keeps_every_order_and_null_is_not_zero(market):
    got = by_key(market.enriched, "order_id")
    assert len(got) == 9
    assert got["o05"]["items_total_brl"] is None and got["o05"]["has_no_items"] and got["o05"]["has_no_payment"]
    assert got["o04"]["payment_total_brl"] == Decimal("0.00") and not got["o04"]["has_no_payment"]


def test_late_means_delivered_and_a_later_calendar_day(market):
    late = {k: v["is_delivered_late"] for k, v in by_key(market.enriched, "order_id").items()}
    assert late == {"o01": False, "o02": True, "o03": False, "o04": False, "o05": False, "o06": False, "o07": False, "o08": False, "o09": False}


def test_person_takes_latest_address_and_recency_from_the_data(market):
    got = by_key(market.people, "customer_unique_id")
    assert got["u1"]["customer_state"] == "RJ" and got["u1"]["order_count"] == 3 and got["u1"]["is_repeat_customer"]
    assert got["u1"]["lifetime_payment_brl"] == Decimal("51.30")
    assert got["u4"]["lifetime_payment_brl"] is None and got["u4"]["avg_order_payment_brl"] is None
    assert min(v["days_since_last_order"] for v in got.values()) == 0 and got["u6"]["days_since_last_order"] == 0


def test_latest_address_tie_goes_to_lowest_account(spark):
    from market import CUSTOMERS, ORDERS

    orders = [r if r[0] != "o01" else (r[0], r[1], r[2], "2017-01-06 10:00:00", *r[4:]) for r in ORDERS]
    got = by_key(Market(spark, orders=orders, customers=CUSTOMERS).people, "customer_unique_id")
    assert got["u1"]["customer_zip_prefix"] == "01001"  # a1 and a2 ordered at the same moment


def test_product_label_falls_back(market):
    got = by_key(market.products, "product_id")
    assert [got[p]["product_category"] for p in ("p1", "p3", "p4")] == ["house", "unknown", "arte"]
    assert got["p3"]["has_no_category"] and not got["p3"]["missing_translation"] and got["p4"]["missing_translation"]
    assert got["p1"]["product_volume_cm3"] == 24 and got["p3"]["product_volume_cm3"] is None


def test_seller_without_geocode_is_flagged(market):
    got = by_key(facts.dim_sellers(market.staged["sellers"], market.centroid), "seller_id")
    assert not got["s1"]["seller_zip_not_geocoded"] and got["s2"]["seller_zip_not_geocoded"] and got["s2"]["seller_latitude"] is None


def test_window_is_half_open_and_a_flag(market):
    inside = {r["order_id"] for r in market.fct_orders.where("is_in_analysis_window").collect()}
    assert inside == {"o01", "o02", "o03", "o04", "o05", "o06", "o09"} and market.fct_orders.count() == 9


def test_monthly_mart(market):
    got = by_key(market.monthly, "month_label")
    assert sorted(got) == ["2017-01", "2017-02", "2017-03"]
    jan, feb, mar = (got[m] for m in sorted(got))
    assert (jan["orders"], jan["active_customers"], jan["delivered_orders"], jan["late_orders"]) == (3, 2, 3, 1)
    assert jan["late_delivery_rate_pct"] == pytest.approx(100 / 3) and jan["delivered_missing_delivery_date"] == 1
    assert jan["gmv_brl"] == Decimal("59.30") and jan["aov_brl"] == pytest.approx(59.30 / 3)
    assert (feb["orders_no_primary_payment"], feb["owi_no_primary_payment"]) == (1, 1)
    assert feb["gmv_no_primary_payment_brl"] == Decimal("5.00") and feb["payment_no_primary_payment_brl"] == 0
    assert mar["gmv_brl"] is None and mar["aov_brl"] is None and mar["orders_with_items"] == 0 and mar["avg_review_score"] is None
    assert (jan["low_score_orders"], jan["reviewed_orders"]) == (1, 3)


def test_category_counts_distinct_orders_per_cell(market):
    got = {(r["month_label"], r["product_category"]): r for r in market.category.collect()}
    house = got["2017-01", "house"]
    assert (house["order_lines"], house["orders"], house["customers"], house["active_sellers"]) == (3, 2, 2, 2)
    assert got["2017-01", "unknown"]["lines_missing_category"] == 1 and got["2017-02", "arte"]["lines_missing_translation"] == 1
    january = sum(r["pct_of_month_gmv"] for k, r in got.items() if k[0] == "2017-01")
    assert january == pytest.approx(100)


def test_payment_mart_leaves_out_unpaid_orders(market):
    got = {(r["month_label"], r["primary_payment_type"]): r for r in market.payment.collect()}
    assert ("2017-03", None) not in got and len(got) == 5
    assert got["2017-02", "credit_card"]["installment_orders"] == 1


def test_profiles(market):
    s = market.staged
    spread = by_key(marts.frequency_distribution(s["orders"], s["customers"]), "orders_per_customer")
    assert {k: v["customers"] for k, v in spread.items()} == {1: 6, 3: 1} and spread[1]["pct_of_customers"] == 85.71
    head = rows(marts.frequency_headline(s["orders"], s["customers"]))[0]
    assert (head["unique_customers"], head["repeat_customers"], head["max_orders_by_one_customer"]) == (7, 1, 3)
    gap = by_key(marts.money_gap(market.items, market.payments), "coverage")
    assert gap["items_only"]["orders"] == 1 and gap["items_only"]["gap_brl"] == Decimal("-5.00")
    spans = by_key(marts.multi_label_orders(market.fct_lines), "n_labels")
    assert spans[2]["orders"] == 1 and spans[1]["orders"] == 7


def test_segments_label_and_tie_break(spark):
    day = dt.datetime(2020, 1, 1)
    people = spark.createDataFrame(
        [(i, "SP", "c", 1, False, day, day, i // 3, None if i == 0 else Decimal(i), 1.0) for i in range(23)],
        "customer_unique_id long, customer_state string, customer_city string, order_count long, is_repeat_customer boolean, "
        "first_purchased_at timestamp, last_purchased_at timestamp, days_since_last_order int, lifetime_payment_brl decimal(12,2), avg_order_payment_brl double")
    orders = spark.createDataFrame(
        [(i, 4.0, 1.0, False, False, "boleto") for i in range(22)],
        "customer_unique_id long, avg_review_score double, items_freight_brl double, is_delivered_late boolean, is_canceled boolean, primary_payment_type string")
    got = by_key(segments.customer_segments(people, orders), "customer_unique_id")
    sizes = [sum(1 for v in got.values() if v["r_score"] == r) for r in (5, 4, 3, 2, 1)]
    assert sizes == [5, 5, 5, 4, 4]
    assert got[0]["m_score"] == 1 and got[0]["r_score"] == 5 and got[0]["rm_segment"] == "Recent low-value"
    assert got[22]["rm_segment"] == "Lapsed high-value" and got[22]["late_orders"] is None


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 40 + [1.0] * 3, [float(i % 997) for i in range(5000)]])
def test_exact_median_equals_sorting(spark, values):
    import statistics

    df = spark.createDataFrame([("k", v, -v) for v in values] + [("empty", None, 1.0)], "key string, a double, b double")
    got = by_key(exact_medians(df, "key", ["a", "b"]), "key")
    assert got["k"]["a"] == statistics.median(values) and got["k"]["b"] == -statistics.median(values)
    assert got["empty"]["a"] is None and got["empty"]["b"] == 1.0


def test_window_constant_matches_fixture():
    assert WINDOW == ("2017-01-01", "2018-01-01")


def test_plan_reads_only_what_the_monthly_mart_needs(spark):
    from workload.world import World

    plan = World(spark, "/root/testdata/sf0.001").monthly._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan  # the unique-keyed geography join is gone
    assert "l_suppkey" not in plan  # and so are unused distinct counts
    assert "GreaterThanOrEqual(o_orderdate" in plan  # the window reaches the scan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
