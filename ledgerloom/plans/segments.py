"""Recency and money quintiles per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import rows_where
from ..operators.order_stats import ntile_columns


def person_behaviour(orders: DataFrame) -> DataFrame:
    """What varies between people: scores, freight, late and cancelled orders, first instrument by name."""
    return orders.groupBy("customer_unique_id").agg(
        F.avg("avg_review_score").alias("avg_review_score"),
        F.avg(F.col("items_freight_brl").cast("double")).alias("avg_freight_brl"),
        rows_where("is_delivered_late").alias("late_orders"),
        rows_where("is_canceled").alias("canceled_orders"),
        F.min("primary_payment_type").alias("sample_payment_type"),
    )


def customer_segments(people: DataFrame, orders: DataFrame, k: int = 5) -> DataFrame:
    """One row per person with r_score (k = most recent), m_score (k = highest value; no payment is
    lowest) and a label. Ties split by person id, the same way on every run.

    ``people`` is read a few times (the bucket ends of both axes are found together); pass a stored table when it is large.
    """
    recency, money = ntile_columns(people, [
        ([("days_since_last_order", False), ("customer_unique_id", False)], k), ([("lifetime_payment_brl", True), ("customer_unique_id", False)], k)])
    scored = people.withColumn("r_score", F.lit(k + 1) - recency).withColumn("m_score", money)
    r, m = F.col("r_score"), F.col("m_score")
    high, low = k - 1, 2
    label = (
        F.when((r >= high) & (m >= high), "Recent high-value")
        .when((r >= high) & (m <= low), "Recent low-value")
        .when((r <= low) & (m >= high), "Lapsed high-value")
        .when((r <= low) & (m <= low), "Lapsed low-value")
        .otherwise("Mid")
    )
    return scored.join(person_behaviour(orders), "customer_unique_id", "left").select(
        "customer_unique_id", "customer_state", "customer_city", "order_count", "is_repeat_customer",
        "first_purchased_at", "last_purchased_at", "days_since_last_order", "lifetime_payment_brl",
        "avg_order_payment_brl", "avg_review_score", "avg_freight_brl", "late_orders", "canceled_orders",
        "sample_payment_type", "r_score", "m_score", (r + m).alias("rm_score"), label.alias("rm_segment"))


def segment_profile(segments: DataFrame) -> DataFrame:
    return segments.groupBy("rm_segment").agg(
        F.count("*").alias("people"),
        F.avg(F.col("lifetime_payment_brl").cast("double")).alias("avg_lifetime_brl"),
        F.avg("days_since_last_order").alias("avg_recency_days"),
    )


def score_matrix(segments: DataFrame) -> DataFrame:
    return segments.groupBy("r_score", "m_score").agg(F.count("*").alias("people"))
