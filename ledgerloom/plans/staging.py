"""Staged tables: one row per raw row, renamed and typed, nothing filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import day_gap
from ..sources.schemas import STAGED_COLUMNS


def _typed(raw: str, kind: str) -> Column:
    if kind == "id":  # identifiers keep the type they are stored in
        return F.col(raw)
    if kind.endswith("^"):
        return F.upper(F.col(raw).cast(kind.rstrip("^")))
    if kind == "timestamp":
        kind = "timestamp_ntz"
    return F.col(raw).cast(kind)


def staged(raw: DataFrame, role: str) -> DataFrame:
    return raw.select(*[_typed(source, kind).alias(name) for source, name, kind in STAGED_COLUMNS[role]])


def orders(raw: DataFrame) -> DataFrame:
    """Adds the delay against the promised day: negative is early, positive is late."""
    return staged(raw, "orders").withColumn(
        "delivery_days_vs_estimate", day_gap("estimated_delivery_at", "delivered_at"))


def order_items(raw: DataFrame) -> DataFrame:
    return staged(raw, "order_items").withColumn(
        "item_total_brl", F.col("item_price_brl") + F.col("item_freight_brl"))


def stage_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    special = {"orders": orders, "order_items": order_items}
    return {role: special[role](df) if role in special else staged(df, role) for role, df in raw.items()}
