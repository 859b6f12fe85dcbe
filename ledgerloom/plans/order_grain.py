"""Children brought to order grain first, then joined to the order spine: joins cannot multiply rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import day_gap, money_sum
from ..operators.median import exact_medians


def items_agg(items: DataFrame) -> DataFrame:
    """One row per order that has lines.

    Sums and distinct counts are separate aggregates on the same key: exact distinct counts expand
    their rows, which then carry the two keys only, and the whole branch disappears from plans that do
    not use the counts.
    """
    sums = items.groupBy("order_id").agg(
        F.count("*").alias("item_count"),
        money_sum(items, "item_price_brl").alias("items_price_brl"),
        money_sum(items, "item_freight_brl").alias("items_freight_brl"),
        money_sum(items, "item_total_brl").alias("items_total_brl"),
    )
    breadth = items.groupBy("order_id").agg(
        F.countDistinct("seller_id").alias("distinct_sellers"), F.countDistinct("product_id").alias("distinct_products"))
    return sums.join(breadth, "order_id", "left").select(
        "order_id", "item_count", "distinct_sellers", "distinct_products", "items_price_brl", "items_freight_brl", "items_total_brl")


def payments_agg(payments: DataFrame) -> DataFrame:
    """One row per paid order, with the instrument that carries the most money.

    Rows collapse to (order, instrument) before the first exchange, so even an order with very many
    rows moves as a few. All order totals then derive from those rows. Equal amounts go to the
    alphabetically first instrument.
    """
    by_type = payments.where("order_id IS NOT NULL").groupBy("order_id", "payment_type").agg(
        money_sum(payments, "payment_value_brl").alias("type_value"),
        F.count("*").alias("type_rows"),
        F.max("payment_installments").alias("type_installments"),
    )
    # Ascending struct order: amount negated, so the smallest is the largest amount; NULL amounts last.
    preference = F.struct(F.col("type_value").isNull(), -F.col("type_value"),
                          F.col("payment_type").isNull(), F.col("payment_type"))
    # few rows for each order are left, which no further collapse ahead of the exchange would make fewer
    return by_type.repartition("order_id").groupBy("order_id").agg(
        F.sum("type_value").alias("payment_total_brl"),
        F.sum("type_rows").alias("payment_count"),
        F.count("payment_type").alias("distinct_payment_types"),
        F.max("type_installments").alias("max_installments"),
        F.min_by("payment_type", preference).alias("primary_payment_type"),
    )


def reviews_agg(reviews: DataFrame) -> DataFrame:
    """One row per reviewed order. Latest = last answered, then last created, then highest review id
    (then highest score, which only matters for rows that agree on all three)."""
    recency = F.struct("review_answered_at", "review_created_at", "review_id", "review_score")
    return reviews.groupBy("order_id").agg(
        F.count("*").alias("review_count"),
        F.avg("review_score").alias("avg_review_score"),
        F.max(recency)["review_score"].alias("latest_review_score"),
    )


def zip_centroid(points: DataFrame) -> DataFrame:
    """One row per zip: exact median position, most frequent label, number of points.

    Points without a zip are left out. Labels collapse to (zip, label) counts before ranking; equal counts go to the alphabetically
    first city, then state.
    """
    points = points.where("zip_prefix IS NOT NULL")
    label_counts = points.groupBy("zip_prefix", "city", "state").agg(F.count("*").alias("n"))
    most_frequent = F.struct(-F.col("n"), F.col("city").isNull(), "city", F.col("state").isNull(), "state")
    labels = label_counts.groupBy("zip_prefix").agg(
        F.sum("n").alias("point_count"), F.min(most_frequent).alias("modal"))
    middles = exact_medians(points, "zip_prefix", ("latitude", "longitude"))
    return labels.join(middles, "zip_prefix", "left").select(
        "zip_prefix", "latitude", "longitude", F.col("modal.city").alias("city"),
        F.col("modal.state").alias("state"), "point_count")


def orders_enriched(
    orders: DataFrame, customers: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame,
) -> DataFrame:
    """The order spine with every child attached; inputs after ``customers`` are at order grain.

    Gaps stay NULL and are countable through the ``has_no_*`` flags. The three order-keyed joins share
    one partitioning of the spine.
    """
    joined = (
        orders
        .join(items.withColumn("_items", F.lit(True)), "order_id", "left")
        .join(payments.withColumn("_payment", F.lit(True)), "order_id", "left")
        .join(reviews.withColumn("_review", F.lit(True)), "order_id", "left")
        .join(customers.select("customer_id", "customer_unique_id", "customer_zip_prefix", "customer_city", "customer_state"),
              "customer_id", "left")
    )
    late = (F.col("order_status") == "delivered") & (F.col("delivery_days_vs_estimate") > 0)
    return joined.select(
        "order_id", "customer_id", "customer_unique_id",
        "customer_zip_prefix", "customer_city", "customer_state",
        "order_status", "purchased_at", "approved_at", "handed_to_carrier_at", "delivered_at", "estimated_delivery_at",
        "item_count", "distinct_sellers", "distinct_products", "items_price_brl", "items_freight_brl", "items_total_brl",
        "payment_total_brl", "payment_count", "distinct_payment_types", "max_installments", "primary_payment_type",
        "review_count", "avg_review_score", "latest_review_score",
        day_gap("purchased_at", "delivered_at").alias("days_purchase_to_delivery"),
        "delivery_days_vs_estimate",
        F.coalesce(late, F.lit(False)).alias("is_delivered_late"),
        F.col("_items").isNull().alias("has_no_items"),
        F.col("_payment").isNull().alias("has_no_payment"),
        F.col("_review").isNull().alias("has_no_review"),
    )
