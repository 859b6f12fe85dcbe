"""Exact medians per key; at most a five-hundredth of the distinct values of a group meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch brackets the middle between these ranks, ten times its own rank error of 1 / 10,000 to either side.
BRACKET = (0.499, 0.501)
SKETCH_ACCURACY = 10_000


def exact_medians(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per key (that has any value) with the interpolated median of each column.

    Pass 1 is a mergeable quantile sketch per key, which brackets the middle five-hundredth of each group.
    Pass 2 counts what lies below the bracket and ranks only the distinct values inside it. The
    bracket is checked against the exact counts, so the result never depends on sketch accuracy.
    """
    sketches = df.groupBy(key).agg(*[
        F.struct(F.percentile_approx(v, list(BRACKET), SKETCH_ACCURACY).alias("cut"), F.count(v).alias("total")).alias(f"_{v}")
        for v in values
    ])
    axes = F.explode(F.array(*[
        F.struct(F.lit(v).alias("axis"), F.col(v).cast("double").alias("value"),
                 F.col(f"_{v}.cut")[0].cast("double").alias("low"), F.col(f"_{v}.cut")[1].cast("double").alias("high"),
                 F.col(f"_{v}.total").alias("total"))
        for v in values
    ]))
    tall = df.select(key, *values).join(sketches, key).select(key, axes.alias("p")).select(key, "p.*")
    # Everything below the bracket shares one NULL value, which sorts first in the running count.
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counts = tall.where(F.col("value") <= F.col("high")).groupBy(key, "axis", inside.alias("value")).agg(
        F.count("*").alias("n"), F.first("total").alias("total"))
    running = Window.partitionBy(key, "axis").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(running))
    after = F.col("upto") - F.col("n")
    lower, upper = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    hit = lambda rank: (after < rank) & (rank <= F.col("upto"))
    middle = ranked.where(hit(lower) | hit(upper)).groupBy(key, "axis").agg(
        F.min("value").alias("a"), F.max("value").alias("b"),
        F.sum(F.when(hit(lower), 1).otherwise(0) + F.when(hit(upper), 1).otherwise(0)).alias("found"),
        F.count_if(F.col("value").isNull()).alias("outside"),
    )
    median = F.when((F.col("found") == 2) & (F.col("outside") == 0), (F.col("a") + F.col("b")) / 2).otherwise(
        F.raise_error(F.lit("quantile bracket missed the median")).cast("double"))
    by_axis = middle.select(key, "axis", median.alias("median"))
    picked = by_axis.groupBy(key).agg(*[
        F.max(F.when(F.col("axis") == v, F.col("median"))).alias(v) for v in values])
    return picked
