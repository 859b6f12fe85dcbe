"""Contract of exported metric tables: header, typed cells, keys, row rules, and reconciliation of the
four grains. Files are read as text by Spark; every step is a frame operation."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.status import OBSERVED, UNAVAILABLE
from ..functions.text import MONTH_LABEL, PARSERS, month_problem
from ..sources.schemas import EXTRACT_COLUMNS, EXTRACT_COMPONENTS, EXTRACT_GRAIN
from .grain import ContractBroken, contiguous_months, unique_combination
from .infer import aov_denominator, infer_numerator

LABEL = {"monthly": None, "category": "product_category", "state": "customer_state", "payment": "primary_payment_type"}
#: The column of each extract that an older file may lack and that its ratios tell.
RECOVERABLE = {"monthly": "low_score_orders", "state": "orders_with_items", "payment": "orders_with_items"}
CORRUPT = "_corrupt_line"


# ------------------------------------------------------------------------------ reading
def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, from its first line only."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader(io.StringIO(first[0]["value"]))) if first and first[0]["value"] else []


def header_problems(header: Sequence[str], required: Sequence[str]) -> list[str]:
    if not header:
        return ["no header"]
    repeated = sorted({c for c in header if list(header).count(c) > 1})
    missing = [c for c in required if c not in header]
    return [f"duplicate columns {repeated}"] * bool(repeated) + [f"missing columns {missing}"] * bool(missing)


def read_extract(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All cells as text, plus the raw line where the number of fields is wrong; without column pruning,
    so that every field of a line is counted."""
    header = read_header(spark, path)
    problems = header_problems(header, required)
    if problems:
        raise ContractBroken(f"{path}: {'; '.join(problems)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).option("escape", '"').csv(path)


# ------------------------------------------------------------------------------ typed cells
def typed_name(column: str) -> str:
    """Money leaves as whole cents, and says so in its name."""
    return column.removesuffix("_brl") + "_c" if column.endswith("_brl") and not column.startswith(("aov", "avg")) else column


def typed_parse(df: DataFrame, spec: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Typed columns plus ``errors``: one text per cell that cannot be read, or is required and empty.
    Money and numbers also keep their printed text as ``<column>_text``."""
    wide = df.selectExpr("*", *[f"{PARSERS[kind](c)} AS _p_{c}" for c, (kind, _) in spec.items()])
    complaints = [f"if({CORRUPT} IS NOT NULL, 'wrong number of fields', NULL)"] if CORRUPT in df.columns else []
    for c, (_, required) in spec.items():
        empty = f"WHEN _p_{c}.value IS NULL THEN '{c}: required value is empty'" if required else ""
        complaints.append(f"CASE WHEN _p_{c}.problem IS NOT NULL THEN concat('{c}: ', _p_{c}.problem) {empty} END")
    return wide.selectExpr(
        *[f"_p_{c}.value AS {typed_name(c)}" for c in spec],
        *[f"{c} AS {c}_text" for c, (kind, _) in spec.items() if kind in ("number", "money")],
        f"array_compact(array({', '.join(complaints)})) AS errors")


def month_contract(df: DataFrame) -> DataFrame:
    """Rows whose month label is not canonical or does not name their purchase month."""
    return df.selectExpr("purchase_month", "month_label", f"{month_problem()} AS problem").where("problem is not null")


# ------------------------------------------------------------------------------ row rules
def extract_rules(name: str) -> dict[str, str]:
    """What must hold inside one row, as SQL predicates."""
    if name == "monthly":
        counts = ("active_customers", "orders_with_items", "canceled_orders", "delivered_orders", "reviewed_orders")
        return {"a month has orders": "orders > 0", "late within delivered": "late_orders <= delivered_orders",
                "goods and freight make GMV": "goods_c + freight_c = gmv_c",
                **{f"{x} within orders": f"{x} <= orders" for x in counts}}
    if name == "category":
        return {"orders between 1 and lines": "orders between 1 and order_lines",
                "goods and freight make GMV": "goods_c + freight_c = gmv_c"}
    if name == "payment":
        return {"installment orders within orders": "installment_orders <= orders"}
    return {}


# ------------------------------------------------------------------------------ status of recovered cells
def with_status(df: DataFrame, column: str, inference: Column | None) -> DataFrame:
    """Adds ``<column>_status``; a column that is not in the file takes its value from ``inference``."""
    if inference is None:
        return df.withColumn(f"{column}_status", F.lit(OBSERVED))
    solved = df.withColumn("_i", inference)
    return solved.withColumn(column, F.col("_i.value")).withColumn(f"{column}_status", F.col("_i.status")).withColumn(
        f"{column}_reason", F.col("_i.reason")).withColumn(f"{column}_candidates", F.col("_i.candidates")).drop("_i")


def inference_log(df: DataFrame, extract: str, column: str) -> DataFrame:
    label = LABEL[extract]
    key = F.concat_ws("/", "month_label", *([label] if label else []))
    return df.select(F.lit(extract).alias("extract"), key.alias("key"), F.lit(column).alias("field"),
                     F.col(f"{column}_status").alias("status"), F.col(column).alias("value"),
                     F.col(f"{column}_candidates").alias("candidates"), F.col(f"{column}_reason").alias("reason"))


# ------------------------------------------------------------------------------ reconciliation
def reconcile(monthly: DataFrame, category: DataFrame, state: DataFrame, payment: DataFrame, has_excluded: bool) -> DataFrame:
    """Per month: (check_name, month_label, result, detail) with result pass, fail, bounded or unsupported.

    Order-exclusive grains must equal the month. Orders summed over categories are only bounded, since
    an order with several categories counts in each. The payment grain leaves out orders without a
    primary instrument: with the excluded population it must equal the month, else it is bounded.
    """
    def totals(df: DataFrame, tag: str, columns: Sequence[str], with_owi: bool) -> DataFrame:
        known = f"orders_with_items_status <> '{UNAVAILABLE}'"
        owi = [f"coalesce(sum(if({known}, orders_with_items, 0)), 0) AS {tag}_owi", f"count_if(NOT ({known})) AS {tag}_unknown",
               f"coalesce(sum(if({known}, 0, orders)), 0) AS {tag}_slack"] if with_owi else []
        sums = [f"coalesce(sum({c}), 0) AS {tag}_{c}" for c in columns] + owi
        return df.groupBy("month_label").agg(*[F.expr(e) for e in sums])

    parts = [totals(category, "c", ("gmv_c", "goods_c", "freight_c", "orders", "order_lines"), False),
             totals(state, "s", ("orders", "gmv_c", "freight_c"), True), totals(payment, "p", ("orders", "gmv_c", "payment_c"), True)]
    money = ("gmv_c", "goods_c", "freight_c", "payment_c")
    wide = reduce(lambda x, y: x.join(y, "month_label", "left"), parts, monthly).na.fill(0, [*money, *[c for p in parts for c in p.columns[1:]]])

    def row(name: str, result: str, shown: Sequence[str], when: str | None = None) -> str:
        made = f"named_struct('check_name', '{name}', 'result', {result}, 'detail', concat_ws(' | ', {', '.join(shown)}))"
        return f"if({when}, {made}, NULL)" if when else made

    def equal(name: str, a: str, b: str, when: str | None = None) -> str:
        return row(name, f"if({a} = {b}, 'pass', 'fail')", (a, b), when)

    def bounded(name: str, low: str, x: str, high: str, when: str | None = None) -> str:
        return row(name, f"if({x} BETWEEN {low} AND {high}, 'bounded', 'fail')", (low, x, high), when)

    owi = "orders_with_items"
    checks = [
        equal("category GMV", "c_gmv_c", "gmv_c"), equal("category goods", "c_goods_c", "goods_c"),
        equal("category freight", "c_freight_c", "freight_c"), bounded("category orders", owi, "c_orders", "c_order_lines"),
        equal("state orders", "s_orders", "orders"), equal("state GMV", "s_gmv_c", "gmv_c"), equal("state freight", "s_freight_c", "freight_c"),
        equal("state orders with items", "s_owi", owi, when="s_unknown = 0"),
        bounded("state orders with items, bounds", "s_owi", owi, "s_owi + s_slack", when="s_unknown > 0"),
    ]
    if has_excluded:
        checks += [
            equal("payment orders and excluded", "p_orders + orders_no_primary_payment", "orders"),
            equal("payment GMV and excluded", "p_gmv_c + gmv_no_primary_payment_c", "gmv_c"),
            equal("payment payments and excluded", "p_payment_c + payment_no_primary_payment_c", "payment_c"),
            equal("payment orders with items and excluded", "p_owi + owi_no_primary_payment", owi),
        ]
    else:
        none, some, over = "orders = p_orders", "orders > p_orders", "orders < p_orders"
        checks += [
            row("payment orders", "'fail'", ("p_orders", "orders"), when=over),
            equal("payment GMV", "p_gmv_c", "gmv_c", when=none), equal("payment payments", "p_payment_c", "payment_c", when=none),
            equal("payment orders with items", "p_owi", owi, when=f"{none} AND p_unknown = 0"),
            bounded("payment orders with items, bounds", "p_owi", owi, "p_owi + p_slack", when=f"{none} AND p_unknown > 0"),
            row("payment GMV, part of month", "if(p_gmv_c <= gmv_c, 'bounded', 'fail')", ("p_gmv_c", "gmv_c"), when=some),
            row("payment orders with items, excluded unknown", "'unsupported'", ("orders - p_orders",), when=some),
        ]
    return wide.selectExpr("month_label", f"explode(array_compact(array({', '.join(checks)}))) AS k").selectExpr(
        "k.check_name", "month_label", "k.result", "k.detail")


def months_within(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Months of the child that the parent does not cover."""
    return child.select("month_label").distinct().join(parent.select("month_label"), "month_label", "left_anti")


# ------------------------------------------------------------------------------ all four together
@dataclass
class ExtractSet:
    monthly: DataFrame
    category: DataFrame
    state: DataFrame
    payment: DataFrame
    components: dict[str, bool]
    inference_log: DataFrame | None
    reconciliation: DataFrame
    violations: DataFrame = field(repr=False, default=None)

    def require(self) -> ExtractSet:
        rows = self.violations.limit(5).collect()
        if rows:
            raise ContractBroken("; ".join(f"{r['extract']} {r['row_key']}: {r['problem']}" for r in rows))
        return self


def _key(name: str) -> str:
    return f"concat_ws('/', month_label, {LABEL[name]})" if LABEL[name] else "month_label"


def _problem(df: DataFrame, extract: str, key: str, problem: str) -> DataFrame:
    return df.selectExpr(f"'{extract}' AS extract", f"{key} AS row_key", f"{problem} AS problem")


def _violations(name: str, df: DataFrame) -> list[DataFrame]:
    """What is wrong inside one extract; cells, month labels and row rules are found in one pass."""
    rules = [f"if(NOT ({ok}), '{rule}', NULL)" for rule, ok in extract_rules(name).items()]
    in_row = f"concat(errors, array_compact(array({', '.join([month_problem(), *rules])})))"
    found = [_problem(df, name, _key(name), f"explode({in_row})"),
             _problem(unique_combination(df.selectExpr(f"{_key(name)} AS row_key"), ["row_key"]), name, "row_key", "'duplicate key'"),
             _problem(df.agg(F.count("*").alias("n")).where("n = 0"), name, "''", "'no data rows'")]
    return found


def _recovered(name: str, df: DataFrame, present: bool) -> tuple[DataFrame, DataFrame | None]:
    """The column an older file lacks, solved from its ratio; rows with unreadable text are not solved."""
    column = RECOVERABLE.get(name)
    if column is None or present:
        return (with_status(df, column, None) if column else df), None
    readable = {c: F.when(F.size("errors") == 0, F.col(f"{c}_text")) for c in ("low_score_rate_pct", "gmv_brl", "aov_brl")}
    solved = (infer_numerator(readable["low_score_rate_pct"], F.col("reviewed_orders")) if name == "monthly"
              else aov_denominator(readable["gmv_brl"], readable["aov_brl"], F.col("orders")))
    df = with_status(df, column, solved)
    return df, inference_log(df, name, column)


def _typed(name: str, text: DataFrame) -> tuple[DataFrame, bool]:
    """Typed cells of one extract, and whether it has its additive components."""
    optional = EXTRACT_COMPONENTS[name]
    present = all(c in text.columns for c in optional)
    return typed_parse(text, EXTRACT_COLUMNS[name] | (optional if present else {})), present


def inferences(texts: Mapping[str, DataFrame]) -> DataFrame | None:
    """The ``inference_log`` of ``assemble`` alone, None if nothing is inferred. Each entry comes from one extract, so only those
    with a recoverable column need to be given."""
    logs = [log for name, text in texts.items() if (log := _recovered(name, *_typed(name, text))[1]) is not None]
    return reduce(DataFrame.unionByName, logs) if logs else None


def assemble(texts: Mapping[str, DataFrame]) -> ExtractSet:
    """Typed, checked and reconciled extracts from their text frames."""
    frames, components, logs, problems = {}, {}, [], []
    for name, text in texts.items():
        parsed, components[name] = _typed(name, text)
        problems += _violations(name, parsed)
        frames[name], log = _recovered(name, parsed, components[name])
        logs += [log] if log is not None else []
    monthly = frames["monthly"]
    in_order = monthly.where(F.col("month_label").rlike(MONTH_LABEL)).selectExpr("to_date(concat(month_label, '-01')) AS purchase_month")
    problems.append(_problem(contiguous_months(in_order), "monthly", "''", "'months are not contiguous'"))
    problems += [_problem(months_within(frames[n], monthly), n, "month_label", "'month outside the monthly extract'")
                 for n in ("category", "state", "payment")]
    checks = reconcile(monthly, frames["category"], frames["state"], frames["payment"], components["monthly"])
    problems.append(_problem(checks.where("result = 'fail'"), "all", "month_label", "concat_ws(': ', check_name, detail)"))
    return ExtractSet(**frames, components=components, inference_log=reduce(DataFrame.unionByName, logs) if logs else None,
                      reconciliation=checks, violations=reduce(DataFrame.unionByName, problems))


def load_extracts(spark: SparkSession, paths: Mapping[str, str]) -> ExtractSet:
    """Reads the four CSV extracts; ``require()`` on the result fails on any violation."""
    return assemble({name: read_extract(spark, paths[name], list(EXTRACT_COLUMNS[name])) for name in EXTRACT_GRAIN})
