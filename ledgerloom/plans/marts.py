"""Metric marts: each keeps the numerators and denominators its ratios are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import (
    as_col, count_where, in_half_open, month_label, percent, ratio, rows_where, sum_where,
)



def _share_of_month(value: str) -> Column:
    """Percentage of the month's total, over the aggregated rows of one mart."""
    return percent(value, F.sum(value).over(Window.partitionBy("purchase_month")))


def _with_distinct(sums: DataFrame, inside: DataFrame, keys: Sequence[str], counted: Mapping[str, str]) -> DataFrame:
    """Adds exact distinct counts per cell, ``{name: column}``, each from an aggregate of its own: its rows carry keys only, and the
    sums collapse to cells before they move. Several counts in one aggregate would expand every row as often, and a task of the
    scan would hold all of its expanded rows at once."""
    for name, column in counted.items():
        counts = inside.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.countDistinct(column).alias(name))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        sums = sums.join(counts, same).drop(*[f"_{k}" for k in keys])
    return sums


#: The grains that the order marts and their checks need, coarse to fine.
GRAINS = {"all": [], "month": ["purchase_month"], "state": ["purchase_month", "customer_state"], "instrument": ["purchase_month", "primary_payment_type"]}


def _order_sums() -> list[Column]:
    has_items, has_review = ~F.col("has_no_items"), ~F.col("has_no_review")
    low = F.col("latest_review_score") <= 2
    no_primary = ~F.col("_primary")
    days = "days_purchase_to_delivery"
    return [
        F.count("*").alias("orders"),
        F.sum("items_total_brl").alias("gmv_brl"),
        F.sum("items_price_brl").alias("goods_brl"),
        F.sum("items_freight_brl").alias("freight_brl"),
        F.sum("payment_total_brl").alias("payment_brl"),
        rows_where(has_items).alias("orders_with_items"),
        rows_where("is_canceled").alias("canceled_orders"),
        rows_where("is_delivered").alias("delivered_orders"),
        rows_where("is_delivered_late").alias("late_orders"),
        rows_where(has_review).alias("reviewed_orders"),
        rows_where(low).alias("low_score_orders"),
        sum_where(days, "is_delivered").alias("delivery_days_sum"),
        count_where(days, "is_delivered").alias("delivery_days_n"),
        rows_where(F.col("is_delivered") & F.col("delivered_at").isNull()).alias("delivered_missing_delivery_date"),
        F.sum("avg_review_score").alias("review_score_sum"),
        F.count("avg_review_score").alias("review_score_n"),
        F.sum("item_count").alias("items_sold"),
        F.count("item_count").alias("items_n"),
        F.sum("max_installments").alias("installments_sum"),
        F.count("max_installments").alias("installments_n"),
        rows_where(F.col("max_installments") > 1).alias("installment_orders"),
        rows_where(no_primary).alias("orders_no_primary_payment"),
        rows_where(no_primary & has_items).alias("owi_no_primary_payment"),
        F.coalesce(sum_where("items_total_brl", no_primary), F.lit(0)).alias("gmv_no_primary_payment_brl"),
        F.coalesce(sum_where("payment_total_brl", no_primary), F.lit(0)).alias("payment_no_primary_payment_brl"),
        rows_where(F.col("is_delivered_late") & ~F.col("is_delivered")).alias("late_not_delivered"),
    ]


def order_cells(orders: DataFrame, grains: Sequence[str] = tuple(GRAINS)) -> DataFrame:
    """Additive measures of the analysis window at several grains from one scan: one grouping set for each, told apart by ``grain``, so
    that a NULL state or instrument is a group of its own and never a total. Rows collapse to cells of all keys together before they move, and
    only these are expanded to the grains."""
    inside = orders.where("is_in_analysis_window").withColumn("_primary", F.col("primary_payment_type").isNotNull())
    keys = list(dict.fromkeys(k for g in grains for k in GRAINS[g]))
    if len(grains) == 1:
        return inside.groupBy(*keys).agg(*_order_sums()).select(F.lit(grains[0]).alias("grain"), "*")
    finest = inside.groupBy(*keys).agg(*_order_sums())
    label = F.lit(None).cast("string")
    for g in grains:
        label = F.when(F.grouping_id() == sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in GRAINS[g]), F.lit(g)).otherwise(label)
    added = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in finest.schema.fields if f.name not in keys]
    sums = finest.groupingSets([[F.col(k) for k in GRAINS[g]] for g in grains], *keys).agg(label.alias("grain"), *added)
    return sums.select("grain", *[c for c in sums.columns if c != "grain"])


def _cells(orders: DataFrame | None, cells: DataFrame | None, grain: str) -> DataFrame:
    return (cells if cells is not None else order_cells(orders, [grain])).where(F.col("grain") == grain)


def monthly_sums(orders: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The monthly mart without its distinct people: headline metrics, their additive components, and the population that a
    by-instrument mart leaves out."""
    return _cells(orders, cells, "month").select(
        "purchase_month", month_label("purchase_month").alias("month_label"),
        "orders", "gmv_brl", "goods_brl", "freight_brl", "payment_brl", "orders_with_items",
        ratio("gmv_brl", "orders_with_items").alias("aov_brl"),
        "canceled_orders", percent("canceled_orders", "orders").alias("cancel_rate_pct"),
        "delivered_orders", "late_orders", percent("late_orders", "delivered_orders").alias("late_delivery_rate_pct"),
        ratio("delivery_days_sum", "delivery_days_n").alias("avg_delivery_days"), "reviewed_orders",
        ratio("review_score_sum", "review_score_n").alias("avg_review_score"),
        percent("low_score_orders", "reviewed_orders").alias("low_score_rate_pct"),
        ratio("items_sold", "items_n").alias("avg_items_per_order"), ratio("installments_sum", "installments_n").alias("avg_installments"),
        "low_score_orders", "delivery_days_sum", "delivery_days_n",
        "delivered_missing_delivery_date", "review_score_sum", "review_score_n", "items_sold", "items_n",
        "installments_sum", "installments_n", "orders_no_primary_payment", "owi_no_primary_payment",
        "gmv_no_primary_payment_brl", "payment_no_primary_payment_brl",
    )


def state_sums(orders: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The state mart without its distinct people."""
    return _cells(orders, cells, "state").select(
        "purchase_month", month_label("purchase_month").alias("month_label"), "customer_state",
        "orders", "gmv_brl", "freight_brl",
        ratio("gmv_brl", "orders_with_items").alias("aov_brl"),
        percent("freight_brl", "gmv_brl").alias("freight_share_pct"),
        ratio("delivery_days_sum", "delivery_days_n").alias("avg_delivery_days"), percent("late_orders", "delivered_orders").alias("late_delivery_rate_pct"),
        ratio("review_score_sum", "review_score_n").alias("avg_review_score"), _share_of_month("gmv_brl").alias("pct_of_month_gmv"),
        "orders_with_items", "delivered_orders", "late_orders", "delivery_days_sum", "delivery_days_n",
        "review_score_sum", "review_score_n",
    )


def monthly_performance(orders: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per month of the analysis window; ``cells`` are stored ``order_cells``, where several marts are built."""
    people = _with_distinct(monthly_sums(orders, cells), orders.where("is_in_analysis_window"), ["purchase_month"], {"active_customers": "customer_unique_id"})
    return people.select("purchase_month", "month_label", "orders", "active_customers", *[c for c in people.columns[3:] if c != "active_customers"])


def category_performance(lines: DataFrame, window: tuple[str, str]) -> DataFrame:
    """One row per month and category at line grain. The window is tested on the line's own purchase
    time, so no join back to the order fact is needed.

    Sums and each of the four distinct counts are separate aggregates, which all read ``lines``: pass the stored fact.
    """
    inside = lines.where(in_half_open("purchased_at", *window))
    sums = inside.groupBy("purchase_month", "product_category").agg(
        F.count("*").alias("order_lines"),
        F.sum("item_total_brl").alias("gmv_brl"),
        F.sum("item_price_brl").alias("goods_brl"),
        F.sum("item_freight_brl").alias("freight_brl"),
        F.count("item_total_brl").alias("priced_lines"),
        rows_where("has_no_category").alias("lines_missing_category"),
        rows_where("missing_translation").alias("lines_missing_translation"),
    )
    cells = _with_distinct(sums, inside, ["purchase_month", "product_category"], {
        "orders": "order_id", "customers": "customer_unique_id", "products_sold": "product_id", "active_sellers": "seller_id"})
    return cells.select(
        "purchase_month", month_label("purchase_month").alias("month_label"), "product_category",
        "order_lines", "orders", "customers", "products_sold", "active_sellers", "gmv_brl", "goods_brl", "freight_brl",
        ratio("gmv_brl", "priced_lines").alias("avg_line_value_brl"),
        percent("freight_brl", "gmv_brl").alias("freight_share_pct"),
        _share_of_month("gmv_brl").alias("pct_of_month_gmv"),
        "lines_missing_category", "lines_missing_translation",
    )


def state_performance(orders: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per month and customer state."""
    people = _with_distinct(state_sums(orders, cells), orders.where("is_in_analysis_window"), ["purchase_month", "customer_state"], {"customers": "customer_unique_id"})
    return people.select("purchase_month", "month_label", "customer_state", "orders", "customers", *[c for c in people.columns[4:] if c != "customers"])


def payment_performance(orders: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One row per month and primary instrument; orders without one are left out, and counted in the
    monthly mart. Amounts are those of whole orders, not of the instrument."""
    source = orders.where("primary_payment_type is not null") if cells is None else None
    return _cells(source, cells, "instrument").where("primary_payment_type is not null").select(
        "purchase_month", month_label("purchase_month").alias("month_label"), "primary_payment_type",
        "orders", "payment_brl", "gmv_brl", ratio("gmv_brl", "orders_with_items").alias("aov_brl"),
        ratio("installments_sum", "installments_n").alias("avg_installments"), "installment_orders", percent("installment_orders", "orders").alias("installment_rate_pct"),
        _share_of_month("orders").alias("pct_of_month_orders"),
        "orders_with_items", "installments_sum", "installments_n",
    )


# ------------------------------------------------------------------------------- profiles
def frequency_distribution(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """How many people placed 1, 2, 3, .. orders, with the share of all people."""
    spread = orders_per_person(orders, customers).groupBy(F.col("order_count").alias("orders_per_customer")).agg(
        F.count("*").alias("customers"))
    return with_share(spread, "customers", "pct_of_customers")


def frequency_headline(orders: DataFrame, customers: DataFrame) -> DataFrame:
    once, again = F.col("order_count") == 1, F.col("order_count") > 1
    return orders_per_person(orders, customers).agg(
        F.count("*").alias("unique_customers"),
        rows_where(once).alias("one_time_customers"),
        F.round(percent(rows_where(once), F.count("*")), 2).alias("pct_one_time"),
        rows_where(again).alias("repeat_customers"),
        F.max("order_count").alias("max_orders_by_one_customer"),
    )


def orders_per_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct orders per person. Orders are counted per account before the join, so that no account
    is a hot key in it; an order belongs to one account."""
    per_account = orders.groupBy("customer_id").agg(F.countDistinct("order_id").alias("n"))
    return customers.select("customer_id", "customer_unique_id").join(per_account, "customer_id").groupBy(
        "customer_unique_id").agg(F.sum("n").alias("order_count"))


def with_share(groups: DataFrame, count: str, name: str, digits: int = 2) -> DataFrame:
    """Adds each group's percentage of the grand total, as a scalar subquery: no one-partition window."""
    total = groups.agg(F.sum(count)).scalar()
    return groups.withColumn(name, F.round(percent(count, total), digits))


def status_profile(orders: DataFrame) -> DataFrame:
    mix = orders.groupBy("order_status").agg(F.count("*").alias("n"))
    return with_share(mix, "n", "pct")


def date_range(orders: DataFrame) -> DataFrame:
    return orders.agg(F.to_date(F.min("purchased_at")).alias("first_order"),
                      F.to_date(F.max("purchased_at")).alias("last_order"), F.count("*").alias("orders"))


def conversion_by_cohort(lead_features: DataFrame) -> DataFrame:
    return lead_features.groupBy(F.trunc("first_contact_date", "MM").alias("cohort_month")).agg(
        F.count("*").alias("leads"), rows_where("is_won").alias("won"),
    ).withColumn("conversion_pct", percent("won", "leads"))


def conversion_by_channel(lead_features: DataFrame) -> DataFrame:
    return lead_features.groupBy("lead_origin_channel").agg(
        F.count("*").alias("leads"), rows_where("is_won").alias("won"),
    ).withColumn("conversion_pct", percent("won", "leads"))


def money_gap(items_by_order: DataFrame, payments_by_order: DataFrame) -> DataFrame:
    """Where item money and paid money differ: orders with both, only payment, or only items."""
    both = items_by_order.select("order_id", "items_total_brl", F.lit(True).alias("_i")).join(
        payments_by_order.select("order_id", "payment_total_brl", F.lit(True).alias("_p")), "order_id", "full")
    coverage = F.when(F.col("_p").isNull(), "items_only").when(F.col("_i").isNull(), "payment_only").otherwise("both")
    return both.groupBy(coverage.alias("coverage")).agg(
        F.count("*").alias("orders"),
        F.sum("items_total_brl").alias("items_brl"),
        F.sum("payment_total_brl").alias("payment_brl"),
        (F.coalesce(F.sum("payment_total_brl"), F.lit(0)) - F.coalesce(F.sum("items_total_brl"), F.lit(0))).alias("gap_brl"),
    )


def multi_label_orders(lines: DataFrame, label: str = "product_category", tasks: int | None = None) -> DataFrame:
    """How many orders span 1, 2, 3, .. labels. ``tasks`` (see ``tasks_for``) deals the (order, label) pairs to as many tasks as they
    need; without it they stay where ``lines`` has its orders, beside the join that made them."""
    pairs = lines.select("order_id", label)
    if tasks:
        pairs = pairs.repartition(tasks, "order_id", label)
    per_order = pairs.distinct().groupBy("order_id").agg(F.count(label).alias("n_labels"))
    return per_order.groupBy("n_labels").agg(F.count("*").alias("orders"))


def payment_mix(payments: DataFrame) -> DataFrame:
    """Rows and money actually paid with each instrument."""
    return payments.groupBy("payment_type").agg(
        F.count("*").alias("n_rows"), F.sum("payment_value_brl").alias("paid_brl"))


def lag_distribution(lead_features: DataFrame) -> DataFrame:
    """Days from contact to win. Lags collapse to counts first; ``percentile`` takes them as weights."""
    lags = lead_features.where("days_to_win is not null").groupBy("days_to_win").agg(F.count("*").alias("n"))
    at = lambda p: F.percentile("days_to_win", p, F.col("n"))
    return lags.agg(
        F.sum("n").alias("wins"), F.min("days_to_win").alias("min_days"), at(0.5).alias("median_days"),
        ratio(F.sum(F.col("days_to_win") * F.col("n")), F.sum("n")).alias("mean_days"),
        at(0.75).alias("p75_days"), at(0.9).alias("p90_days"), F.max("days_to_win").alias("max_days"),
    )


def key_cardinality(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys, keys seen once, and the largest group."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(as_col(key).isNotNull())
    return sizes.agg(F.count("*").alias("distinct_keys"), rows_where(F.col("n") == 1).alias("single_row_keys"),
                     F.max("n").alias("largest_group"))
