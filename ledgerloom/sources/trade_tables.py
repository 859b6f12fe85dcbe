"""Maps a trade star schema (customer, orders, lineitem, part, supplier, events) to the raw
marketplace sources, row by row. Every raw frame scales with its table; nothing is filtered except
where the role itself is a subset (paid lines, reviewed lines, signups, won leads).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Declared schemas, so that opening a table needs no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days=days)


def _zip(nation: str, balance: str) -> Column:
    band = F.floor((F.col(balance) + 1000) / 1000).cast("int")
    return F.concat(F.lpad(F.col(nation).cast("string"), 2, "0"), F.lpad(band.cast("string"), 3, "0"))


def _state(nation: str) -> Column:
    return F.concat(F.lit("n"), F.lpad(F.col(nation).cast("string"), 2, "0"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate")
    days = (F.floor("o_totalprice") % 31).cast("int")
    return src.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "canceled").otherwise("shipped").alias("order_status"),
        placed.alias("order_purchase_timestamp"),
        placed.alias("order_approved_at"),
        _plus_days(placed, F.lit(2)).alias("order_delivered_carrier_date"),
        F.when((F.col("o_orderstatus") != "O") & (F.col("o_orderpriority") != "4-NOT SPECIFIED"), _plus_days(placed, days)).alias("order_delivered_customer_date"),
        _plus_days(placed, F.lit(20)).alias("order_estimated_delivery_date"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("freight_value"),
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed lines are the paid ones: an order may have items and no payment."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(flag == "A", "boleto").when(flag == "N", "credit_card").otherwise("voucher").alias("payment_type"),
        (F.col("l_quantity").cast("int") % 10 + 1).alias("payment_installments"),
        F.col("l_extendedprice").alias("payment_value"),
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines carry a review; open lines have an unanswered one."""
    shipped = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.round(F.col("l_discount") * 100).cast("int") % 5 + 1).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        shipped.alias("review_creation_date"),
        F.when(F.col("l_linestatus") == "F", _plus_days(shipped, F.lit(3))).alias("review_answer_timestamp"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts per person, so a person can hold several addresses."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("c_custkey div 2").alias("customer_unique_id"),
        _zip("c_nationkey", "c_acctbal").alias("customer_zip_code_prefix"),
        F.lower("c_mktsegment").alias("customer_city"),
        _state("c_nationkey").alias("customer_state"),
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _zip("c_nationkey", "c_acctbal").alias("geolocation_zip_code_prefix"),
        (F.col("c_acctbal") / 100).alias("geolocation_lat"),
        (F.col("c_custkey") % 180).cast("double").alias("geolocation_lng"),
        F.lower("c_mktsegment").alias("geolocation_city"),
        _state("c_nationkey").alias("geolocation_state"),
    )


def _category() -> Column:
    return F.when(F.col("p_type") != "ECONOMY", F.concat(F.lower("p_type"), F.lit("_"), F.substring_index("p_brand", "#", -1)))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        _category().alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_name").alias("product_description_lenght"),
        (size % 7).alias("product_photos_qty"),
        (size * 10).alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"),
    )


def product_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known translations: promotional categories have none."""
    return (
        table(spark, sf_dir, "part").where(~F.col("p_type").isin("PROMO", "ECONOMY"))
        .select(_category().alias("product_category_name")).distinct()
        .select("product_category_name", F.concat(F.lit("en_"), "product_category_name").alias("product_category_name_english"))
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seller_id"),
        _zip("s_nationkey", "s_acctbal").alias("seller_zip_code_prefix"),
        F.lower("s_name").alias("seller_city"),
        _state("s_nationkey").alias("seller_state"),
    )


def _signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "signup")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are leads; the page is the key in their properties, the channel follows the user."""
    user = F.col("user_id") % 5
    return _signups(spark, sf_dir).select(
        F.col("event_id").alias("mql_id"),
        F.to_date("ts").alias("first_contact_date"),
        F.get_json_object("props", "$.k").alias("landing_page_id"),
        F.when(user == 0, "direct").when(user == 1, "email").when(user == 2, "organic").when(user == 3, "paid_search").alias("origin"),
    )


def closed_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup worth at least 5 closed, after as many days as its value less two."""
    lag = (F.floor("value") - 2).cast("int")
    none = F.lit(None).cast("string")
    return _signups(spark, sf_dir).where(F.col("value") >= 5).select(
        F.col("event_id").alias("mql_id"),
        F.col("event_id").alias("seller_id"),
        none.alias("sdr_id"), none.alias("sr_id"),
        _plus_days(F.col("ts"), lag).alias("won_date"),
        none.alias("business_segment"), none.alias("lead_type"), none.alias("lead_behaviour_profile"),
        none.alias("has_company"), none.alias("has_gtin"), none.alias("average_stock"), none.alias("business_type"),
        F.col("value").alias("declared_product_catalog_size"),
        (F.col("value") * 10).alias("declared_monthly_revenue"),
    )


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per order: assignment by key, exposure only inside the assigned arm."""
    assigned = F.col("o_orderkey") % 20 < 17
    return table(spark, sf_dir, "orders").select(
        assigned.cast("int").alias("treatment"),
        (F.col("o_orderstatus") == "F").cast("int").alias("conversion"),
        (F.col("o_orderstatus") != "O").cast("int").alias("visit"),
        (assigned & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("exposure"),
        (F.col("o_totalprice") / 1000).alias("f0"),
        F.dayofyear("o_orderdate").cast("double").alias("f1"),
        F.year("o_orderdate").alias("segment"),
    )


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score) with heavy ties: order value in steps, label delivered or not."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.floor(F.col("o_totalprice") / 4000) / 200).alias("score"),
    )


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score) from labelled documents: quality against a stepped text length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"),
        # rises with the length without end and stays below 1; whole numbers until the last step keep it exact
        (F.expr("(n_chars * 200) div (n_chars + 2000)") / 200).alias("score"),
    )


RAW = {
    "orders": orders, "order_items": order_items, "order_payments": order_payments,
    "order_reviews": order_reviews, "customers": customers, "products": products, "sellers": sellers,
    "geolocation": geolocation, "product_categories": product_categories, "leads": leads,
    "closed_deals": closed_deals,
}
