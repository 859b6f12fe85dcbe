"""Dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import day_gap, in_half_open, month_start


def dim_customers(customers: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row per person: latest address, order history, days since the last order of the data.

    Orders collapse per account before the join, so an account holding a large part of all orders is
    one row there. The address is that of the account with the latest order, lowest account id first.
    """
    history = enriched.groupBy("customer_id").agg(
        F.count("*").alias("n"),
        F.min("purchased_at").alias("first_at"),
        F.max("purchased_at").alias("last_at"),
        F.sum("payment_total_brl").alias("paid"),
        F.count("payment_total_brl").alias("n_paid"),
    )
    accounts = customers.select(
        "customer_id", "customer_unique_id", "customer_state", "customer_city", "customer_zip_prefix",
    ).join(history, "customer_id")
    latest_first = F.struct(F.col("last_at").isNull(), -F.unix_micros(F.col("last_at").cast("timestamp")), F.col("customer_id"))
    address = F.struct("customer_state", "customer_city", "customer_zip_prefix")
    people = accounts.groupBy("customer_unique_id").agg(
        F.min_by(address, latest_first).alias("address"),
        F.sum("n").alias("order_count"),
        F.min("first_at").alias("first_purchased_at"),
        F.max("last_at").alias("last_purchased_at"),
        F.sum("paid").alias("lifetime_payment_brl"),
        F.sum("n_paid").alias("n_paid"),
    )
    anchor = enriched.agg(F.max("purchased_at")).scalar()
    return people.select(
        "customer_unique_id", "address.customer_state", "address.customer_city", "address.customer_zip_prefix",
        "order_count", (F.col("order_count") > 1).alias("is_repeat_customer"),
        "first_purchased_at", "last_purchased_at", "lifetime_payment_brl",
        F.try_divide(F.col("lifetime_payment_brl").cast("double"), F.col("n_paid").cast("double")).alias("avg_order_payment_brl"),
        day_gap("last_purchased_at", anchor).alias("days_since_last_order"),
    )


def dim_geography(centroid: DataFrame) -> DataFrame:
    return centroid.select("zip_prefix", "latitude", "longitude", "city", "state",
                           F.col("point_count").alias("source_point_count"))


def dim_products(products: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row per product; label falls back from translation to original to 'unknown'."""
    named = products.join(lookup.select("product_category_pt", "product_category_en"), "product_category_pt", "left")
    original, translated = F.col("product_category_pt"), F.col("product_category_en")
    return named.select(
        "product_id", "product_category_pt", "product_category_en",
        F.coalesce(translated, original, F.lit("unknown")).alias("product_category"),
        original.isNull().alias("has_no_category"),
        (original.isNotNull() & translated.isNull()).alias("missing_translation"),
        "product_photos_qty", "product_weight_g",
        (F.col("product_length_cm").cast("long") * F.col("product_height_cm") * F.col("product_width_cm")).alias("product_volume_cm3"),
    )


def dim_sellers(sellers: DataFrame, centroid: DataFrame) -> DataFrame:
    spots = centroid.select(F.col("zip_prefix").alias("seller_zip_prefix"),
                            F.col("latitude").alias("seller_latitude"), F.col("longitude").alias("seller_longitude"),
                            F.lit(True).alias("_found"))
    return sellers.join(spots, "seller_zip_prefix", "left").select(
        "seller_id", "seller_state", "seller_city", "seller_zip_prefix", "seller_latitude", "seller_longitude",
        F.col("_found").isNull().alias("seller_zip_not_geocoded"))


def fct_orders(enriched: DataFrame, geography: DataFrame, window: tuple[str, str]) -> DataFrame:
    """One row per order, with the analysis window as a flag (end exclusive); marts filter on it."""
    spots = geography.select(F.col("zip_prefix").alias("customer_zip_prefix"), F.col("latitude").alias("customer_latitude"),
                             F.col("longitude").alias("customer_longitude"), F.lit(True).alias("_found"))
    return enriched.join(spots, "customer_zip_prefix", "left").select(
        "order_id", "customer_unique_id", "purchased_at",
        F.to_date("purchased_at").alias("purchase_date"),
        month_start("purchased_at").alias("purchase_month"),
        "customer_state", "customer_city", "customer_latitude", "customer_longitude",
        F.col("_found").isNull().alias("customer_zip_not_geocoded"),
        "order_status",
        (F.col("order_status") == "delivered").alias("is_delivered"),
        (F.col("order_status") == "canceled").alias("is_canceled"),
        "item_count", "distinct_sellers", "items_price_brl", "items_freight_brl", "items_total_brl",
        "payment_total_brl", "payment_count", "max_installments", "primary_payment_type",
        "delivered_at", "days_purchase_to_delivery", "delivery_days_vs_estimate", "is_delivered_late",
        "avg_review_score", "latest_review_score",
        in_half_open("purchased_at", *window).alias("is_in_analysis_window"),
        "has_no_items", "has_no_payment", "has_no_review",
    )


def fct_order_items(items: DataFrame, spine: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order line. ``spine`` needs order_id, customer_unique_id, purchased_at,
    customer_state and order_status; joining the bare spine avoids recomputing order aggregates."""
    heads = spine.select("order_id", "customer_unique_id", "purchased_at", "customer_state", "order_status")
    labels = products.select("product_id", "product_category", "product_category_en", "has_no_category", "missing_translation")
    return items.join(labels, "product_id", "left").join(heads, "order_id").select(
        "order_id", "order_item_seq", "product_id", "seller_id", "customer_unique_id", "purchased_at",
        F.to_date("purchased_at").alias("purchase_date"),
        month_start("purchased_at").alias("purchase_month"),
        "product_category", "product_category_en", "has_no_category", "missing_translation",
        "customer_state", "order_status",
        (F.col("order_status") == "delivered").alias("is_delivered"),
        "item_price_brl", "item_freight_brl", "item_total_brl",
    )


def spine_heads(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The order columns the line fact needs, without any order-grain aggregate."""
    people = customers.select("customer_id", "customer_unique_id", "customer_state")
    return orders.join(people, "customer_id", "left")
