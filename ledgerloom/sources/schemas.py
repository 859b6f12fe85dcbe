"""Raw column names and types per source, and the staged name of each column."""

from __future__ import annotations

from pyspark.sql import types as T

# role -> ((raw column, staged column, staged type), ...). A type ending in ``^`` is upper-cased text.
STAGED_COLUMNS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "orders": (
        ("order_id", "order_id", "id"),
        ("customer_id", "customer_id", "id"),
        ("order_status", "order_status", "string"),
        ("order_purchase_timestamp", "purchased_at", "timestamp"),
        ("order_approved_at", "approved_at", "timestamp"),
        ("order_delivered_carrier_date", "handed_to_carrier_at", "timestamp"),
        ("order_delivered_customer_date", "delivered_at", "timestamp"),
        ("order_estimated_delivery_date", "estimated_delivery_at", "timestamp"),
    ),
    "order_items": (
        ("order_id", "order_id", "id"),
        ("order_item_id", "order_item_seq", "int"),
        ("product_id", "product_id", "id"),
        ("seller_id", "seller_id", "id"),
        ("shipping_limit_date", "shipping_limit_at", "timestamp"),
        ("price", "item_price_brl", "decimal(12,2)"),
        ("freight_value", "item_freight_brl", "decimal(12,2)"),
    ),
    "order_payments": (
        ("order_id", "order_id", "id"),
        ("payment_sequential", "payment_seq", "int"),
        ("payment_type", "payment_type", "string"),
        ("payment_installments", "payment_installments", "int"),
        ("payment_value", "payment_value_brl", "decimal(12,2)"),
    ),
    "order_reviews": (
        ("review_id", "review_id", "id"),
        ("order_id", "order_id", "id"),
        ("review_score", "review_score", "int"),
        ("review_comment_title", "review_comment_title", "string"),
        ("review_comment_message", "review_comment_message", "string"),
        ("review_creation_date", "review_created_at", "timestamp"),
        ("review_answer_timestamp", "review_answered_at", "timestamp"),
    ),
    "customers": (
        ("customer_id", "customer_id", "id"),
        ("customer_unique_id", "customer_unique_id", "id"),
        ("customer_zip_code_prefix", "customer_zip_prefix", "string"),
        ("customer_city", "customer_city", "string"),
        ("customer_state", "customer_state", "string^"),
    ),
    "products": (
        ("product_id", "product_id", "id"),
        ("product_category_name", "product_category_pt", "string"),
        ("product_name_lenght", "product_name_length", "int"),
        ("product_description_lenght", "product_description_length", "int"),
        ("product_photos_qty", "product_photos_qty", "int"),
        ("product_weight_g", "product_weight_g", "int"),
        ("product_length_cm", "product_length_cm", "int"),
        ("product_height_cm", "product_height_cm", "int"),
        ("product_width_cm", "product_width_cm", "int"),
    ),
    "sellers": (
        ("seller_id", "seller_id", "id"),
        ("seller_zip_code_prefix", "seller_zip_prefix", "string"),
        ("seller_city", "seller_city", "string"),
        ("seller_state", "seller_state", "string^"),
    ),
    "geolocation": (
        ("geolocation_zip_code_prefix", "zip_prefix", "string"),
        ("geolocation_lat", "latitude", "double"),
        ("geolocation_lng", "longitude", "double"),
        ("geolocation_city", "city", "string"),
        ("geolocation_state", "state", "string^"),
    ),
    "product_categories": (
        ("product_category_name", "product_category_pt", "string"),
        ("product_category_name_english", "product_category_en", "string"),
    ),
    "leads": (
        ("mql_id", "mql_id", "id"),
        ("first_contact_date", "first_contact_date", "date"),
        ("landing_page_id", "landing_page_id", "string"),
        ("origin", "lead_origin_channel", "string"),
    ),
    "closed_deals": (
        ("mql_id", "mql_id", "id"),
        ("seller_id", "seller_id", "id"),
        ("sdr_id", "sdr_id", "string"),
        ("sr_id", "sr_id", "string"),
        ("won_date", "won_at", "timestamp"),
        ("business_segment", "business_segment", "string"),
        ("lead_type", "lead_type", "string"),
        ("lead_behaviour_profile", "lead_behaviour_profile", "string"),
        ("has_company", "has_company", "string"),
        ("has_gtin", "has_gtin", "string"),
        ("average_stock", "average_stock", "string"),
        ("business_type", "business_type", "string"),
        ("declared_product_catalog_size", "declared_catalog_size", "double"),
        ("declared_monthly_revenue", "declared_monthly_revenue_brl", "double"),
    ),
}

# role -> true grain of the staged table (geolocation has none).
GRAIN: dict[str, tuple[str, ...]] = {
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_seq"),
    "order_payments": ("order_id", "payment_seq"),
    "order_reviews": ("review_id", "order_id"),
    "customers": ("customer_id",),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "product_categories": ("product_category_pt",),
    "leads": ("mql_id",),
    "closed_deals": ("mql_id",),
}

ORDER_STATUSES = ("delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created", "approved")
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
REVIEW_SCORES = (1, 2, 3, 4, 5)

# extract -> {column: (kind, required)}; kinds are the parsers of functions/text.py.
EXTRACT_COLUMNS: dict[str, dict[str, tuple[str, bool]]] = {
    "monthly": {
        "purchase_month": ("text", True), "month_label": ("text", True),
        "orders": ("count", True), "active_customers": ("count", True),
        "gmv_brl": ("money", False), "goods_brl": ("money", False), "freight_brl": ("money", False),
        "payment_brl": ("money", False), "orders_with_items": ("count", True), "aov_brl": ("number", False),
        "canceled_orders": ("count", True), "cancel_rate_pct": ("number", False),
        "delivered_orders": ("count", True), "late_orders": ("count", True),
        "late_delivery_rate_pct": ("number", False), "avg_delivery_days": ("number", False),
        "reviewed_orders": ("count", True), "avg_review_score": ("number", False),
        "low_score_rate_pct": ("number", False), "avg_items_per_order": ("number", False),
        "avg_installments": ("number", False),
    },
    "category": {
        "purchase_month": ("text", True), "month_label": ("text", True), "product_category": ("text", True),
        "order_lines": ("count", True), "orders": ("count", True), "customers": ("count", True),
        "products_sold": ("count", True), "active_sellers": ("count", True), "gmv_brl": ("money", True),
        "goods_brl": ("money", True), "freight_brl": ("money", True), "avg_line_value_brl": ("number", False),
        "freight_share_pct": ("number", False), "pct_of_month_gmv": ("number", False),
        "lines_missing_category": ("count", True), "lines_missing_translation": ("count", True),
    },
    "state": {
        "purchase_month": ("text", True), "month_label": ("text", True), "customer_state": ("text", True),
        "orders": ("count", True), "customers": ("count", True), "gmv_brl": ("money", False),
        "freight_brl": ("money", False), "aov_brl": ("number", False), "freight_share_pct": ("number", False),
        "avg_delivery_days": ("number", False), "late_delivery_rate_pct": ("number", False),
        "avg_review_score": ("number", False), "pct_of_month_gmv": ("number", False),
    },
    "payment": {
        "purchase_month": ("text", True), "month_label": ("text", True), "primary_payment_type": ("text", True),
        "orders": ("count", True), "payment_brl": ("money", False), "gmv_brl": ("money", False),
        "aov_brl": ("number", False), "avg_installments": ("number", False),
        "installment_orders": ("count", True), "installment_rate_pct": ("number", False),
        "pct_of_month_orders": ("number", False),
    },
}

# extract -> additive components that older files may lack.
EXTRACT_COMPONENTS: dict[str, dict[str, tuple[str, bool]]] = {
    "monthly": {
        "low_score_orders": ("count", True), "delivery_days_sum": ("count", False),
        "delivery_days_n": ("count", True), "delivered_missing_delivery_date": ("count", True),
        "review_score_sum": ("number", False), "review_score_n": ("count", True),
        "items_sold": ("count", False), "items_n": ("count", True),
        "installments_sum": ("count", False), "installments_n": ("count", True),
        "orders_no_primary_payment": ("count", True), "owi_no_primary_payment": ("count", True),
        "gmv_no_primary_payment_brl": ("money", True), "payment_no_primary_payment_brl": ("money", True),
    },
    "category": {},
    "state": {
        "orders_with_items": ("count", True), "delivered_orders": ("count", True), "late_orders": ("count", True),
        "delivery_days_sum": ("count", False), "delivery_days_n": ("count", True),
        "review_score_sum": ("number", False), "review_score_n": ("count", True),
    },
    "payment": {
        "orders_with_items": ("count", True), "installments_sum": ("count", False), "installments_n": ("count", True),
    },
}

EXTRACT_GRAIN: dict[str, tuple[str, ...]] = {
    "monthly": ("purchase_month",),
    "category": ("purchase_month", "product_category"),
    "state": ("purchase_month", "customer_state"),
    "payment": ("purchase_month", "primary_payment_type"),
}

# Words that would reveal a cost, offer or assignment column.
COST_WORDS = (
    "cost", "spend", "budget", "campaign", "offer", "discount", "promo", "coupon",
    "treatment", "control", "ab_", "variant",
)


def raw_schema(role: str) -> T.StructType:
    """Explicit read schema of a raw source: ids and zips stay text, so leading zeros survive."""
    def raw_type(kind: str) -> T.DataType:
        if kind == "id" or kind.startswith("string"):
            return T.StringType()
        if kind == "timestamp":
            return T.TimestampNTZType()
        return T._parse_datatype_string(kind)

    return T.StructType([T.StructField(raw, raw_type(kind)) for raw, _, kind in STAGED_COLUMNS[role]])
