"""Reading raw tables, score files, documented counts, and profiling what is there."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import COST_WORDS, raw_schema


#: Roles whose cells may hold line breaks; files of all others can be split.
FREE_TEXT = frozenset({"order_reviews"})


def read_raw(spark: SparkSession, path: str, role: str, fmt: str = "csv") -> DataFrame:
    """A raw source with its declared schema; header order must match, as the CSV reader enforces."""
    reader = spark.read.schema(raw_schema(role))
    if fmt == "csv":
        return reader.option("header", True).option("enforceSchema", False).option("multiLine", role in FREE_TEXT).option(
            "escape", '"').csv(path)
    return reader.format(fmt).load(path)


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """An exported CSV with every column as text, for the typed parse of a data contract."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path)


def read_scores(spark: SparkSession, path: str, id_col: str, label_col: str, score_cols: Iterable[str]) -> DataFrame:
    """Stored scores. Doubles are parsed by the JVM reader, which rounds correctly."""
    header = spark.read.option("header", True).csv(path).columns
    doubles = set(score_cols)
    schema = T.StructType([
        T.StructField(c, T.DoubleType() if c in doubles else T.IntegerType() if c == label_col else T.StringType())
        for c in header
    ])
    scores = spark.read.schema(schema).option("header", True).csv(path)
    return scores.select(id_col, label_col, *score_cols)


def read_documented_counts(spark: SparkSession, path: str) -> DataFrame:
    """Arm counts from a JSON document: {"counts": {...}, "inferred": {"y_exposed": {"value": n}}}."""
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("n_t", "y_t", "n_c", "y_c", "n_exposed", "y_exposed")])
    inferred = T.StructType([T.StructField("y_exposed", T.StructType([T.StructField("value", T.LongType())]))])
    document = spark.read.schema(T.StructType([T.StructField("counts", counts), T.StructField("inferred", inferred)])).option(
        "multiLine", True).json(path)
    return document.select(
        "counts.n_t", "counts.y_t", "counts.n_c", "counts.y_c", "counts.n_exposed",
        F.coalesce("counts.y_exposed", "inferred.y_exposed.value").alias("y_exposed"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: (table_name, n_rows). All scans run as one job with a single small exchange;
    tables without rows are kept with 0."""
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()])
    counted = tagged.groupBy("table_name").agg(F.count("*").alias("n_rows"))
    names = next(iter(tables.values())).sparkSession.createDataFrame([(n,) for n in tables], "table_name string")
    return names.join(counted, "table_name", "left").na.fill(0, ["n_rows"])


def column_listing(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (table, column), from schemas only: no data is read."""
    rows = [(name, position, field.name) for name, df in tables.items()
            for position, field in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string")


def scan_columns(spark: SparkSession, tables: Mapping[str, DataFrame], words: Iterable[str] = COST_WORDS) -> DataFrame:
    """Per table: number of columns and how many names contain one of ``words``."""
    lowered = F.lower("column_name")
    hit = reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])
    return column_listing(spark, tables).groupBy("table_name").agg(
        F.count("*").alias("n_columns"), F.count_if(hit).alias("n_hits"))
