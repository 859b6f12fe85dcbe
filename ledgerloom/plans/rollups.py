"""Re-aggregating metric marts for a chosen month range, with the status of every number.

Inputs are typed extracts or ``from_mart`` views: money in whole cents, months as YYYY-MM labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import status as st
from ..functions.measures import cents_per, percent


def from_mart(mart: DataFrame) -> DataFrame:
    """A mart as roll-up input: every ``*_brl`` money column becomes whole cents named ``*_c``."""
    columns = []
    for f in mart.schema.fields:
        if f.name.endswith("_brl") and isinstance(f.dataType, T.DecimalType):
            columns.append((F.col(f.name) * 100).cast("bigint").alias(f.name.removesuffix("_brl") + "_c"))
        else:
            columns.append(F.col(f.name))
    return mart.select(*columns)


def selection_problem(months: DataFrame, first: str, last: str) -> Column:
    """Aggregate over the rows of ``months`` (month_label): why first..last can't be selected, or NULL."""
    if first > last:
        return F.lit(f"{first} lies after {last}")
    ends = {first, last}
    seen = F.countDistinct(F.when(F.col("month_label").isin(*ends), F.col("month_label")))
    return F.when(seen < len(ends), F.lit(f"no data for an end of {first}..{last}"))


class SelectionError(PySparkValueError):
    """A range of months that can't be selected."""


def month_range(df: DataFrame, first: str, last: str, months: DataFrame | None = None) -> DataFrame:
    """Rows of ``first`` .. ``last``. A reversed range is an error, and so is an end that is not among ``months`` (by default
    those of ``df``); the ends are looked up in one small aggregate when the range is asked for. A mart that merely has no row in
    a known month is no error."""
    known = months if months is not None else df
    problem = known.agg(selection_problem(known, first, last)).first()[0] if first <= last else f"{first} lies after {last}"
    if problem:
        raise SelectionError(message=problem)
    return df.where(F.col("month_label").between(first, last))


def selections(months: DataFrame, ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per range: (first, last, problem)."""
    rows = [months.agg(selection_problem(months, a, b).alias("problem")).select(F.lit(a).alias("first"), F.lit(b).alias("last"), "problem") for a, b in ranges]
    return reduce(DataFrame.unionByName, rows)


def _status_of(df: DataFrame, column: str) -> str | None:
    name = f"{column}_status"
    return name if name in df.columns else None


def _mean(df: DataFrame, total: str, valid: str, mean: str) -> Column:
    return st.combined_mean(total, valid, mean) if valid in df.columns else st.combined_mean(None, None, mean)


# ------------------------------------------------------------------------------ overview
def overview(monthly: DataFrame, first: str, last: str) -> DataFrame:
    """One row of totals and rates. ``naive_late_mean`` averages the monthly rates; it is here only to
    show how far it is from the real rate."""
    chosen = month_range(monthly, first, last)
    sums = {"orders": "orders", "orders_with_items": "orders_with_items", "gmv": "gmv_c", "goods": "goods_c", "freight": "freight_c",
            "payments": "payment_c", "canceled": "canceled_orders", "delivered": "delivered_orders", "late": "late_orders",
            "reviewed": "reviewed_orders", "low": "low_score_orders"}
    late_rate = F.when(F.col("delivered_orders") > 0, percent("late_orders", "delivered_orders"))
    whole = chosen.agg(
        *[st.sum_field(c, _status_of(monthly, c)).alias(n) for n, c in sums.items()],
        F.avg(late_rate).alias("naive_late_mean"), F.count("*").alias("months"),
        _mean(monthly, "delivery_days_sum", "delivery_days_n", "avg_delivery_days").alias("delivery_days"),
        _mean(monthly, "review_score_sum", "review_score_n", "avg_review_score").alias("review_score"),
        _mean(monthly, "items_sold", "items_n", "avg_items_per_order").alias("items_per_order"),
        _mean(monthly, "installments_sum", "installments_n", "avg_installments").alias("installments"),
        st.single_cell_only("active_customers").alias("active_customers"))
    return whole.select(
        "*", st.money_average("gmv", "orders_with_items").alias("aov"), st.rate("canceled", "orders").alias("cancel_rate"),
        st.rate("late", "delivered").alias("late_rate"), st.rate("low", "reviewed").alias("low_rate"),
        st.rate("freight", "gmv").alias("freight_share"))


def overview_series(monthly: DataFrame, first: str, last: str) -> DataFrame:
    """The months of a selection side by side."""
    chosen = month_range(monthly, first, last)
    low_status = _status_of(monthly, "low_score_orders")
    state = F.col(low_status) if low_status else F.lit(st.OBSERVED)
    return chosen.select(
        "month_label", "orders", "gmv_c", percent("late_orders", "delivered_orders").alias("late_rate"),
        F.when(state != st.UNAVAILABLE, percent("low_score_orders", "reviewed_orders")).alias("low_rate"), state.alias("low_status"),
        percent("canceled_orders", "orders").alias("cancel_rate"), cents_per("gmv_c", "orders_with_items").alias("aov_c"),
        "avg_delivery_days", "avg_review_score", "active_customers")


# ------------------------------------------------------------------------------ categories
class CategoryView(NamedTuple):
    rows: DataFrame
    totals: DataFrame


def categories(
    category: DataFrame, first: str, last: str, search: str = "", sort: str = "gmv", top: int | None = None,
    months: DataFrame | None = None,
) -> CategoryView:
    """Per category of the selection, filtered by a case-insensitive substring; totals ignore the filter.

    For one category orders add across months, as an order lies in one month. Across categories they
    do not, so their sum is named ``category_order_pairs``.
    """
    chosen = month_range(category, first, last, months)
    total_gmv = chosen.agg(st.sum_field("gmv_c").alias("t")).scalar()
    grouped = chosen.groupBy("product_category").agg(
        F.count("*").alias("cells"),
        *[F.sum(c).alias(c) for c in ("order_lines", "goods_c", "orders", "lines_missing_category", "lines_missing_translation")],
        st.sum_field("gmv_c").alias("gmv"), st.sum_field("freight_c").alias("freight"),
        st.single_cell_only("customers").alias("customers"), st.single_cell_only("active_sellers").alias("sellers"))
    wide = grouped.withColumn("_total", total_gmv).select(
        "*", st.rate("freight", "gmv").alias("freight_share"), cents_per("gmv.value", "order_lines").alias("avg_line_c"),
        st.rate("gmv", "_total").alias("share_of_selected_gmv")).drop("_total")
    wanted = search.strip().lower()
    matches = F.lower("product_category").contains(wanted) if wanted else F.lit(True)
    matched = wide.where(matches)
    keys = {"gmv": [F.desc_nulls_last("gmv.value")], "lines": [F.desc("order_lines")], "name": [],
            "freight_share": [F.coalesce("freight_share.value", F.lit(0.0)).desc()]}[sort]
    ordered = matched.orderBy(*keys, F.asc("product_category"))
    totals = chosen.agg(
        st.sum_field("gmv_c").alias("total_gmv"), F.sum("order_lines").alias("total_lines"), F.sum("orders").alias("category_order_pairs"),
        F.sum("lines_missing_category").alias("lines_missing_category"), F.sum("lines_missing_translation").alias("lines_missing_translation"),
        F.countDistinct("product_category").alias("all_count"),
        F.countDistinct(F.when(matches, F.col("product_category"))).alias("matched_count"))
    totals = totals.withColumn("no_match", (F.col("all_count") > 0) & (F.col("matched_count") == 0))
    return CategoryView(ordered.limit(top) if top else ordered, totals)


# ------------------------------------------------------------------------------ states
def states(state: DataFrame, first: str, last: str, chosen: Sequence[str] | None = None, months: DataFrame | None = None) -> DataFrame:
    """Per customer state and, with ``is_total``, for all chosen states: one grouping pass for both."""
    rows = month_range(state, first, last, months)
    if chosen is not None:
        rows = rows.where(F.col("customer_state").isin(list(chosen)))
    has_late = "late_orders" in state.columns
    late = [st.sum_field("late_orders").alias("_late"), st.sum_field("delivered_orders").alias("_delivered")] if has_late else [
        st.combined_mean(None, None, "late_delivery_rate_pct").alias("late_rate")]
    blocks = rows.rollup("customer_state").agg(
        F.grouping("customer_state").cast("boolean").alias("is_total"), F.count("*").alias("cells"), F.sum("orders").alias("orders"),
        st.sum_field("gmv_c").alias("gmv"), st.sum_field("freight_c").alias("freight"),
        st.sum_field("orders_with_items", _status_of(state, "orders_with_items")).alias("orders_with_items"), *late,
        _mean(state, "delivery_days_sum", "delivery_days_n", "avg_delivery_days").alias("delivery_days"),
        st.single_cell_only("customers").alias("customers"))
    out = blocks.where(F.col("cells") > 0).select(
        "*", st.money_average("gmv", "orders_with_items").alias("aov"), st.rate("freight", "gmv").alias("freight_share"))
    if has_late:
        out = out.withColumn("late_rate", st.rate("_late", "_delivered")).drop("_late", "_delivered")
    return out.orderBy("is_total", F.coalesce("gmv.value", F.lit(0)).desc(), "customer_state")


# ------------------------------------------------------------------------------ payments
def payments(payment: DataFrame, first: str, last: str, types: Sequence[str] | None = None, months: DataFrame | None = None) -> DataFrame:
    """Per primary instrument. Shares keep all orders of the selection as denominator, also when only
    some instruments are chosen."""
    rows = month_range(payment, first, last, months)
    all_orders = rows.agg(st.sum_field("orders").alias("t")).scalar()
    if types is not None:
        rows = rows.where(F.col("primary_payment_type").isin(list(types)))
    grouped = rows.groupBy("primary_payment_type").agg(
        F.count("*").alias("cells"), st.sum_field("orders").alias("orders"), F.sum("payment_c").alias("payment_c"),
        st.sum_field("gmv_c").alias("gmv"), st.sum_field("installment_orders").alias("installment_orders"),
        st.sum_field("orders_with_items", _status_of(payment, "orders_with_items")).alias("orders_with_items"),
        _mean(payment, "installments_sum", "installments_n", "avg_installments").alias("installments"))
    return grouped.withColumn("_all", all_orders).select(
        "*", st.rate("orders", "_all").alias("share_of_orders"), st.money_average("gmv", "orders_with_items").alias("aov"),
        st.rate("installment_orders", "orders").alias("installment_rate"),
    ).drop("_all").orderBy(F.desc("orders.value"), "primary_payment_type")


# ------------------------------------------------------------------------------ decision facts
def decision_totals(monthly: DataFrame) -> DataFrame:
    """Totals and weighted rates over all months, with the unweighted late rate beside them."""
    totals = monthly.agg(
        F.min("month_label").alias("first_month"), F.max("month_label").alias("last_month"),
        *[F.sum(c).alias(c) for c in ("orders", "orders_with_items", "gmv_c", "freight_c", "late_orders", "delivered_orders",
                                       "low_score_orders", "reviewed_orders", "canceled_orders")],
        F.avg(percent("late_orders", "delivered_orders")).alias("naive_late_pct"))
    return totals.select(
        "*", cents_per("gmv_c", "orders_with_items").alias("aov_c"), percent("late_orders", "delivered_orders").alias("late_pct"),
        percent("low_score_orders", "reviewed_orders").alias("low_score_pct"), percent("canceled_orders", "orders").alias("cancel_pct"),
        percent("freight_c", "gmv_c").alias("freight_pct"))


def worst_months(monthly: DataFrame, n: int = 3) -> DataFrame:
    """The months with the highest late rate, later month first among equals."""
    return monthly.select("month_label", "late_orders", "delivered_orders", percent("late_orders", "delivered_orders").alias("late_pct")).where(
        "late_pct is not null").orderBy(F.desc("late_pct"), F.desc("month_label")).limit(n)


def freight_extremes(state: DataFrame) -> DataFrame:
    """The states with the lowest and highest freight share of GMV."""
    by_state = state.groupBy("customer_state").agg(
        F.sum("orders").alias("orders"), F.sum("gmv_c").alias("gmv_c"), F.sum("freight_c").alias("freight_c"),
    ).withColumn("share", percent("freight_c", "gmv_c")).where("share is not null")
    entry, rank = F.struct("customer_state", "share", "orders"), F.struct("share", "customer_state")
    ends = by_state.agg(F.min_by(entry, rank).alias("lo"), F.max_by(entry, rank).alias("hi"))
    return ends.select(*[F.col(f"{e}.{c}").alias(f"{n}_{c}") for e, n in (("lo", "lowest"), ("hi", "highest")) for c in ("customer_state", "share", "orders")])


def status_counts(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many cells or checks have each outcome."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"))
