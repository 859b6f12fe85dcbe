"""Counts that only look at earlier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_and_full_counts(
    df: DataFrame, key: str, day: str, prior: str = "prior_count", full: str | None = None,
) -> DataFrame:
    """Adds the number of rows with the same key and a strictly earlier day, and optionally the number
    over all days (which looks ahead, so it is only for reproducing older feature sets).

    Rows collapse to one per (key, day) first, so the running sum covers days, never the rows of a
    popular key. A row without key has 0 earlier rows and no full count.
    """
    daily = df.where(F.col(key).isNotNull()).groupBy(key, day).agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(key)
    earlier = by_key.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    history = daily.withColumn("_prior", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if full:
        history = history.withColumn(full, F.sum("_n").over(by_key))
    joined = df.join(history.drop("_n"), [key, day], "left")
    columns = [*df.columns, F.coalesce("_prior", F.lit(0)).alias(prior)] + ([full] if full else [])
    return joined.select(*columns)


def prior_count_by_range(df: DataFrame, key: str, day: str, name: str = "prior_count") -> DataFrame:
    """The same count by another route: rows per (key, day), and for each day the sum over a range of day numbers that
    ends before it. The window holds days, never the rows of a popular key."""
    daily = df.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key, F.unix_date(day).alias("_day")).agg(F.count("*").alias("_n"))
    window = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    history = daily.select(key, "_day", F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_prior"))
    joined = df.withColumn("_day", F.unix_date(day)).join(history, [key, "_day"], "left")
    return joined.select(*df.columns, F.coalesce("_prior", F.lit(0)).alias(name))
