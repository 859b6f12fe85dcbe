"""The marketplace built from one folder of trade tables; every member is a lazy plan."""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.measures import in_half_open
from ledgerloom.plans import facts, lead_features, marts, order_grain, rollups, staging
from ledgerloom.session import stage
from ledgerloom.sources import trade_tables

WINDOW = ("1996-01-01", "2001-01-01")
HORIZON = 90
SCOPE_FROM = "2024-01-10"
MART_ORDERS = (
    "order_id", "purchase_month", "is_in_analysis_window", "customer_unique_id", "customer_state", "items_total_brl", "items_price_brl",
    "items_freight_brl", "payment_total_brl", "has_no_items", "has_no_review", "latest_review_score", "primary_payment_type", "days_purchase_to_delivery",
    "is_canceled", "is_delivered", "is_delivered_late", "delivered_at", "avg_review_score", "item_count", "max_installments")
MART_LINES = (
    "purchased_at", "purchase_month", "product_category", "order_id", "customer_unique_id", "product_id", "seller_id", "item_total_brl", "item_price_brl",
    "item_freight_brl", "has_no_category", "missing_translation")


class World:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: set[str] = set()

    def raw(self, role: str) -> DataFrame:
        return trade_tables.RAW[role](self.spark, self.sf_dir)

    def staged(self, role: str) -> DataFrame:
        return staging.stage_all({role: self.raw(role)})[role]

    def table(self, name: str) -> DataFrame:
        return trade_tables.table(self.spark, self.sf_dir, name)

    def keep(self, name: str) -> DataFrame:
        """Writes a member that several parts of one query read, and uses the written table from here on."""
        if name not in self.kept:
            self.__dict__[name], _ = stage(getattr(self, name), name)
            self.kept.add(name)
        return self.__dict__[name]

    @cached_property
    def items_agg(self) -> DataFrame:
        return order_grain.items_agg(self.staged("order_items"))

    @cached_property
    def payments_agg(self) -> DataFrame:
        return order_grain.payments_agg(self.staged("order_payments"))

    @cached_property
    def reviews_agg(self) -> DataFrame:
        return order_grain.reviews_agg(self.staged("order_reviews"))

    @cached_property
    def centroid(self) -> DataFrame:
        return order_grain.zip_centroid(self.staged("geolocation"))

    @cached_property
    def enriched(self) -> DataFrame:
        return order_grain.orders_enriched(
            self.staged("orders"), self.staged("customers"), self.items_agg, self.payments_agg, self.reviews_agg)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return facts.fct_orders(self.enriched, facts.dim_geography(self.centroid), WINDOW)

    @cached_property
    def mart_orders(self) -> DataFrame:
        """What marts and their checks read of the order fact; this is what is written when several of them do."""
        return self.fct_orders.where("is_in_analysis_window").select(*MART_ORDERS)

    @cached_property
    def mart_lines(self) -> DataFrame:
        """The same of the line fact."""
        return self.fct_lines.where(in_half_open("purchased_at", *WINDOW)).select(*MART_LINES)

    @cached_property
    def products(self) -> DataFrame:
        return facts.dim_products(self.staged("products"), self.staged("product_categories"))

    @cached_property
    def fct_lines(self) -> DataFrame:
        heads = facts.spine_heads(self.staged("orders"), self.staged("customers"))
        return facts.fct_order_items(self.staged("order_items"), heads, self.products)

    @cached_property
    def people(self) -> DataFrame:
        return facts.dim_customers(self.staged("customers"), self.enriched)

    @cached_property
    def order_cells(self) -> DataFrame:
        return marts.order_cells(self.mart_orders)

    def with_cells(self) -> DataFrame:
        """Writes the order measures of all grains once; marts built from here on read them."""
        self.keep("order_cells")
        for name in {"monthly", "state", "payment"} - self.kept:
            self.__dict__.pop(name, None)
        return self.order_cells

    @property
    def _cells(self) -> DataFrame | None:
        return self.order_cells if "order_cells" in self.kept else None

    @cached_property
    def monthly(self) -> DataFrame:
        return marts.monthly_performance(self.mart_orders, self._cells)

    @cached_property
    def category(self) -> DataFrame:
        return marts.category_performance(self.keep("mart_lines"), WINDOW)

    @cached_property
    def state(self) -> DataFrame:
        return marts.state_performance(self.mart_orders, self._cells)

    @cached_property
    def payment(self) -> DataFrame:
        return marts.payment_performance(self.mart_orders, self._cells)

    @cached_property
    def leads(self) -> DataFrame:
        return lead_features.lead_features(self.staged("leads"), self.staged("closed_deals"), HORIZON, SCOPE_FROM)

    @cached_property
    def rct(self) -> DataFrame:
        return trade_tables.experiment(self.spark, self.sf_dir)

    def rollup_input(self, mart: str) -> DataFrame:
        return rollups.from_mart(self.keep(mart))

    def text_extracts(self, components: bool = True, written: bool = True, names: Collection[str] | None = None) -> dict[str, DataFrame]:
        """The four marts, or those of ``names``, as exported text: every cell a string, ratios to four decimals. Without
        ``components`` the files look like older ones that lack the additive columns. Checks that read
        an extract several times want it ``written``."""
        from ledgerloom.sources.schemas import EXTRACT_COLUMNS

        self.keep("mart_orders")
        self.with_cells()
        texts = {}
        for name, columns in EXTRACT_COLUMNS.items():
            if names is not None and name not in names:
                continue
            mart = self.keep(name) if written else getattr(self, name)
            cells = []
            for f in mart.schema.fields:
                if not components and f.name not in columns:
                    continue
                value = F.col(f.name)
                if isinstance(f.dataType, T.DoubleType):
                    value = F.round(value, 4).cast("decimal(24,4)")
                cells.append(value.cast("string").alias(f.name))
            texts[name] = mart.select(*cells)
        return texts


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: counts as bigint, money as decimal(38,2), doubles to six decimals."""
    columns = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.ByteType)):
            value = value.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            value = value.cast("decimal(38,2)")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6)
        columns.append(value.alias(f.name))
    return df.select(*columns)
