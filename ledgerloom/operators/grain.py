"""Data contracts: each check returns a frame of what is wrong, so an empty frame means it holds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measures import month_number, ratio, rows_where

MONEY = "decimal(38,2)"


class ContractBroken(ValueError):
    """Raised by ``require`` with the first rows of each broken check."""


def require(checks: Mapping[str, DataFrame], show: int = 4) -> None:
    """Fail when any check frame has rows; only a few of them reach the driver."""
    broken = {name: [r.asDict() for r in df.limit(show).collect()] for name, df in checks.items()}
    broken = {name: rows for name, rows in broken.items() if rows}
    if broken:
        raise ContractBroken("; ".join(f"{name}: {rows}" for name, rows in broken.items()))


def _tall(df: DataFrame, names: Iterable[str], key: str, value: str, cast: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per named column of a small wide frame."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(n).cast(cast).alias(value)) for n in names]))
    return df.select(*carry, cells.alias("_cell")).select(*carry, "_cell.*")


# ------------------------------------------------------------------------ single table
def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_null) for every column, in one pass."""
    counted = df.agg(*[rows_where(F.col(c).isNull()).alias(c) for c in cols])
    return _tall(counted, cols, "column_name", "n_null", "bigint")


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return null_counts(df, cols).where("n_null > 0")


def unique_combination(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key groups that occur more than once."""
    return df.groupBy(*cols).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def unique(df: DataFrame, col: str) -> DataFrame:
    """Repeated values of one column; NULLs are the business of ``not_null``."""
    return unique_combination(df.where(F.col(col).isNotNull()), [col])


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Values outside the accepted set, with their row counts."""
    return df.where(~F.col(col).isin(list(values))).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n_rows"))


def probe_grain(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Per candidate key: distinct combinations, excess rows, and whether it is a key. One pass."""
    labels = [", ".join(c) for c in candidates]
    counted = df.agg(F.count("*").alias("_rows"), *[
        F.countDistinct(F.struct(*c)).alias(label) for c, label in zip(candidates, labels)])
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("candidate_key"), F.col(f"`{x}`").alias("distinct_keys")) for x in labels]))
    return counted.select("_rows", cells.alias("c")).select(
        "c.candidate_key", F.col("_rows").alias("n_rows"), "c.distinct_keys",
        (F.col("_rows") - F.col("c.distinct_keys")).alias("excess_rows"),
        (F.col("_rows") == F.col("c.distinct_keys")).alias("is_key"))


def contiguous_months(df: DataFrame, month: str = "purchase_month") -> DataFrame:
    """Empty when every month between the first and the last occurs."""
    number = month_number(month)
    span = df.agg(F.countDistinct(number).alias("months"), (F.max(number) - F.min(number) + 1).cast("bigint").alias("month_span"))
    return span.where("months <> month_span")


def month_gaps(df: DataFrame, month: str = "purchase_month") -> DataFrame:
    """The months before and after each gap; the month list is short by nature."""
    months = df.select(F.col(month).alias("after_month")).distinct()
    previous = F.lag("after_month").over(Window.orderBy("after_month"))
    return months.withColumn("before_month", previous).where(
        month_number("after_month") - month_number("before_month") > 1)


def row_rules(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys.., broken_rule) for each row and rule that does not hold; a NULL outcome does not count."""
    broken = F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])))
    return df.select(*keys, broken.alias("broken_rule"))


def buckets_even(df: DataFrame, col: str, k: int) -> DataFrame:
    """Empty when ``col`` has exactly k buckets whose sizes differ by at most one."""
    sizes = df.groupBy(col).agg(F.count("*").alias("n"))
    return bucket_spread(sizes, col).where((F.col("buckets") != k) | (F.col("spread") > 1))


def bucket_spread(sizes: DataFrame, col: str) -> DataFrame:
    return sizes.agg(F.count("*").alias("buckets"), (F.max("n") - F.min("n")).alias("spread")).select(
        F.lit(col).alias("axis"), "buckets", "spread")


def recency_anchor(people: DataFrame) -> DataFrame:
    """Someone must have ordered on the last day of the data."""
    return people.agg(F.min("days_since_last_order").alias("min_days")).where(F.coalesce(F.col("min_days") != 0, F.lit(True)))


def lead_label_contract(features: DataFrame, horizon: int = 90) -> DataFrame:
    """Rows whose label, maturity date or page counts contradict their definition.

    That the first day of a page has no earlier leads is checked on (page, day) rows; only pages that
    break it, normally none, are joined back.
    """
    daily = features.groupBy("landing_page_id", "first_contact_date").agg(
        rows_where(F.col("page_lead_volume_prior") != 0).alias("n_bad"))
    broken_start = daily.groupBy("landing_page_id").agg(
        F.min("first_contact_date").alias("first_contact_date"), F.min_by("n_bad", "first_contact_date").alias("n_bad"),
    ).where("n_bad > 0").select("landing_page_id", "first_contact_date", F.lit(True).alias("_starts_late"))
    expected = F.coalesce(F.col("days_to_win").between(0, horizon), F.lit(False))
    wrong = (
        (F.col("is_won") != expected)
        | (F.col("label_mature_on") != F.date_add("first_contact_date", horizon + 1))
        | F.coalesce(F.col("page_lead_volume_prior") > F.col("page_lead_volume") - 1, F.lit(False))
        | (F.col("_starts_late").isNotNull() & (F.col("page_lead_volume_prior") != 0))
    )
    return features.join(broken_start, ["landing_page_id", "first_contact_date"], "left").where(wrong).select(
        "mql_id", "is_won", "days_to_win", "label_mature_on", "page_lead_volume", "page_lead_volume_prior")


# ------------------------------------------------------------------------ several tables
def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child keys that no parent has, with row counts. Child rows collapse per key first."""
    keys = child.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("orphan_key")).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(parent_col).alias("orphan_key")), "orphan_key", "left_anti")


def missing_children(parent: DataFrame, key: str, children: Mapping[str, DataFrame]) -> DataFrame:
    """Per child table: parents without any row in it, and child rows without a parent."""
    parts = []
    for name, child in children.items():
        present = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        sides = parent.select(key, F.lit(True).alias("_parent")).join(present, key, "full")
        parts.append(sides.agg(
            rows_where(F.col("_parent") & F.col("n").isNull()).alias("parents_without_child"),
            F.coalesce(F.sum(F.when(F.col("_parent").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
        ).select(F.lit(name).alias("child_table"), "parents_without_child", "orphan_rows"))
    return reduce(DataFrame.unionByName, parts)


def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows and keys on both sides, right rows with a match, and matched keys per left key."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    known = F.col(key).isNotNull()
    has_left, has_right = F.col("n_left").isNotNull(), F.col("n_right").isNotNull()
    return a.join(b, key, "full").agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("left_rows"), rows_where(known & has_left).alias("left_keys"),
        F.coalesce(F.sum("n_right"), F.lit(0)).alias("right_rows"), rows_where(known & has_right).alias("right_keys"),
        F.coalesce(F.sum(F.when(has_left, F.col("n_right"))), F.lit(0)).alias("matched_right_rows"),
        rows_where(has_left & has_right).alias("matched_keys"),
    ).withColumn("matched_pct", ratio("matched_keys", "left_keys", 100.0))


def fanout_report(parent: DataFrame, children: Mapping[str, DataFrame], key: str, measures: Mapping[str, str]) -> DataFrame:
    """What a direct inner join of a parent and its children would do, computed without running it.

    Per key, joined rows are the product of the row counts and each measure repeats as often as the
    other tables have rows. Every table collapses to one row per key first. ``measures`` maps a child
    to the column to total. Returns one row per measure.
    """
    spine = parent.groupBy(key).agg(F.count("*").alias("_n"))
    for name, child in children.items():
        sums = [F.sum(F.col(measures[name]).cast(MONEY)).alias(f"{name}_sum")] if name in measures else []
        spine = spine.join(child.groupBy(key).agg(F.count("*").alias(f"{name}_n"), *sums), key, "full")
    counts = ["_n"] + [f"{c}_n" for c in children]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in counts]) & F.col(key).isNotNull()

    def product(names: Sequence[str]) -> Column:
        """Of row counts, in 38 digits; NULL beyond them."""
        return reduce(lambda a, b: F.try_multiply(a, b).try_cast("decimal(38,0)"), [F.col(c).cast("decimal(38,0)") for c in names])

    def repeated(name: str) -> tuple[Column, Column]:
        """The repeated total of a measure, and whether some key's share of it has too many digits."""
        others = product([c for c in counts if c != f"{name}_n"])
        cents = F.try_multiply((F.col(f"{name}_sum") * 100).cast("decimal(38,0)"), others).try_cast("decimal(38,0)")
        present = whole & F.col(f"{name}_sum").isNotNull()
        return F.try_sum(F.when(whole, cents)), F.count_if(present & cents.isNull()) > 0

    rows, sums = product(counts), {m: repeated(m) for m in measures}
    totals = spine.agg(
        F.sum("_n").alias("parent_rows"), F.try_sum(F.when(whole, rows)).alias("_rows"), (F.count_if(whole & rows.isNull()) > 0).alias("_wide"),
        rows_where(F.col("_n").isNotNull() & ~whole).alias("parent_keys_lost"), rows_where(whole).alias("_whole"),
        *[F.sum(f"{m}_sum").alias(f"{m}_true") for m in measures],
        *[total.alias(f"{m}_cents") for m, (total, _) in sums.items()], *[wide.alias(f"{m}_wide") for m, (_, wide) in sums.items()])
    # a total that leaves 38 digits (or the sum of them) is reported as such, not as a number
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"{m}_true").cast(MONEY).alias("true_total"),
                 F.when(~F.col(f"{m}_wide"), (F.col(f"{m}_cents") / 100).try_cast(MONEY)).alias("joined_total"),
                 F.when(F.col(f"{m}_wide") | F.col(f"{m}_cents").isNull() & (F.col("_whole") > 0) & F.col(f"{m}_true").isNotNull(), "too large").otherwise("ok").alias("total_status"))
        for m in measures]))
    joined = F.when(~F.col("_wide"), F.col("_rows").try_cast("bigint"))
    return totals.select("parent_rows", joined.alias("joined_rows"), "parent_keys_lost", cells.alias("m")).select(
        "parent_rows", "joined_rows", "parent_keys_lost", "m.*").withColumn("inflation", ratio("joined_total", "true_total"))


# ------------------------------------------------------------------------ totals against totals
OPERATORS = {
    "=": lambda a, b: a.eqNullSafe(b),
    "<=": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ">=": lambda a, b: F.coalesce(a >= b, F.lit(False)),
}


def compare_totals(sources: Sequence[DataFrame], rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Evaluates (check, left metric, operator, right metric) rules on one-row frames of metrics.

    Metrics are unioned as (metric, value) rows, so the sources are never joined with each other.
    """
    metrics = reduce(DataFrame.unionByName, [_tall(s, s.columns, "metric", "value", MONEY) for s in sources])
    sides = metrics.sparkSession.createDataFrame(
        [(check, op, side, metric) for check, left, op, right in rules for side, metric in (("left", left), ("right", right))],
        "check_name string, op string, side string, metric string")
    # The broadcast side has one row per metric named in code.
    paired = sides.join(F.broadcast(metrics), "metric", "left").groupBy("check_name", "op").agg(
        F.max(F.when(F.col("side") == "left", F.col("value"))).alias("left_value"),
        F.max(F.when(F.col("side") == "right", F.col("value"))).alias("right_value"))
    outcome = F.lit(False)
    for op, test in OPERATORS.items():
        outcome = F.when(F.col("op") == op, test(F.col("left_value"), F.col("right_value"))).otherwise(outcome)
    return paired.select("check_name", "op", "left_value", "right_value", outcome.alias("holds"))


def equal_rowcount(a: DataFrame, b: DataFrame) -> DataFrame:
    return compare_totals([a.agg(F.count("*").alias("a")), b.agg(F.count("*").alias("b"))], [("equal row counts", "a", "=", "b")])


def money_survives(fine: Sequence[tuple[DataFrame, Sequence[tuple[str, str]]]], coarse: DataFrame) -> DataFrame:
    """For each fine-grained table and its (fine column, coarse column) pairs: the totals agree. The
    coarse table is read once for all of them."""
    pairs = [pair for _, table_pairs in fine for pair in table_pairs]
    totals = [df.agg(*[F.sum(a).alias(f"fine {a}") for a, _ in table_pairs]) for df, table_pairs in fine]
    return compare_totals(
        [*totals, coarse.agg(*[F.sum(b).alias(f"coarse {b}") for _, b in pairs])],
        [(f"{a} survives as {b}", f"fine {a}", "=", f"coarse {b}") for a, b in pairs])


def facts_agree(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return compare_totals(
        [orders.agg(F.sum("items_total_brl").alias("order money"), rows_where(~F.col("has_no_items")).alias("orders with items")),
         lines.agg(F.sum("item_total_brl").alias("line money"), F.countDistinct("order_id").alias("orders in lines"))],
        [("same item money", "order money", "=", "line money"), ("same orders with items", "orders with items", "=", "orders in lines")])


def metric_layer_reconciles(cells: DataFrame, lines: DataFrame, monthly: DataFrame, category: DataFrame, state: DataFrame, payment: DataFrame, line_window: Column) -> DataFrame:
    """The four marts against the two facts, over the whole analysis window. ``cells`` are stored ``marts.order_cells``: their grain
    ``all`` is the order fact as a whole and ``month`` its calendar, from the same scan as the marts."""
    number = month_number("purchase_month")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    truth = cells.where("grain = 'all'").agg(
        F.sum("orders").alias("orders"), F.sum("gmv_brl").alias("gmv"),
        F.sum(F.col("orders") - F.col("orders_no_primary_payment")).alias("orders with primary"),
        whole(F.coalesce("gmv_brl", F.lit(0)) - F.col("gmv_no_primary_payment_brl")).alias("gmv with primary"),
        F.sum("orders_with_items").alias("orders with items"))
    calendar = cells.where("grain = 'month'").agg(F.count("purchase_month").alias("months"), (F.max(number) - F.min(number) + 1).alias("month span"))
    line_truth = lines.where(line_window).agg(F.count("*").alias("lines"))
    m = monthly.agg(F.count("*").alias("m months"), F.sum("orders").alias("m orders"), F.sum("gmv_brl").alias("m gmv"),
                    F.sum("orders_with_items").alias("m orders with items"))
    c = category.agg(F.sum("gmv_brl").alias("c gmv"), F.sum("order_lines").alias("c lines"), F.sum("orders").alias("c summed orders"))
    s = state.agg(F.sum("gmv_brl").alias("s gmv"), F.sum("orders").alias("s orders"))
    p = payment.agg(whole("gmv_brl").alias("p gmv"), F.sum("orders").alias("p orders"))
    return compare_totals([truth, calendar, line_truth, m, c, s, p], [
        ("monthly has every month", "m months", "=", "months"), ("no month is skipped", "months", "=", "month span"),
        ("monthly orders", "m orders", "=", "orders"), ("monthly gmv", "m gmv", "=", "gmv"),
        ("monthly orders with items", "m orders with items", "=", "orders with items"),
        ("category gmv", "c gmv", "=", "gmv"), ("state gmv", "s gmv", "=", "gmv"), ("state orders", "s orders", "=", "orders"),
        ("payment gmv", "p gmv", "=", "gmv with primary"), ("payment orders", "p orders", "=", "orders with primary"),
        ("category lines", "c lines", "=", "lines"),
        ("summed category orders, lower bound", "c summed orders", ">=", "orders with items"),
        ("summed category orders, upper bound", "c summed orders", "<=", "c lines"),
    ])


def payment_scope_by_month(monthly: DataFrame, payment: DataFrame) -> DataFrame:
    """Months where the payment mart plus the excluded population is not the whole month."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    paid = payment.groupBy("month_label").agg(
        F.sum("orders").alias("p_orders"), F.sum("orders_with_items").alias("p_owi"),
        F.sum("gmv_brl").alias("p_gmv"), F.sum("payment_brl").alias("p_pay"))
    both = monthly.join(paid, "month_label", "left")
    return both.where(
        (zero("p_orders") + F.col("orders_no_primary_payment") != F.col("orders"))
        | (zero("p_owi") + F.col("owi_no_primary_payment") != F.col("orders_with_items"))
        | (zero("p_gmv") + F.col("gmv_no_primary_payment_brl") != zero("gmv_brl"))
        | (zero("p_pay") + F.col("payment_no_primary_payment_brl") != zero("payment_brl"))
    ).select("month_label")


def additive_components_agree(cells: DataFrame, monthly: DataFrame, state: DataFrame, payment: DataFrame) -> DataFrame:
    """Components of the marts agree with each other and with the order fact as a whole (the grain ``all`` of ``cells``)."""
    sums = lambda df, tag, cols: df.agg(*[F.sum(c).alias(f"{tag} {c}") for c in cols])
    m = sums(monthly, "m", ["orders_with_items", "delivered_orders", "late_orders", "delivery_days_n", "delivery_days_sum",
                            "review_score_n", "reviewed_orders", "items_n", "low_score_orders"])
    s = sums(state, "s", ["orders_with_items", "delivered_orders", "late_orders", "delivery_days_n", "delivery_days_sum", "review_score_n"])
    p = sums(payment, "p", ["orders_with_items", "installments_n", "orders"])
    f = cells.where("grain = 'all'").agg(
        F.sum(F.col("orders_with_items") - F.col("owi_no_primary_payment")).alias("f orders_with_items"),
        F.sum(F.col("orders") - F.col("orders_no_primary_payment")).alias("f orders"),
        F.sum("late_not_delivered").alias("late but not delivered"), F.lit(0).alias("zero"))
    broken_months = payment_scope_by_month(monthly, payment).agg(F.count("*").alias("broken months"))
    shared = ["orders_with_items", "delivered_orders", "late_orders", "delivery_days_n", "delivery_days_sum", "review_score_n"]
    return compare_totals([m, s, p, f, broken_months], [(f"state {c}", f"s {c}", "=", f"m {c}") for c in shared] + [
        ("payment scope, every month", "broken months", "=", "zero"),
        ("reviewed orders have a score", "m review_score_n", "=", "m reviewed_orders"),
        ("orders with items have a count", "m items_n", "=", "m orders_with_items"),
        ("timed deliveries are deliveries", "m delivery_days_n", "<=", "m delivered_orders"),
        ("late deliveries are deliveries", "m late_orders", "<=", "m delivered_orders"),
        ("late implies delivered", "late but not delivered", "=", "zero"),
        ("payment orders with items", "p orders_with_items", "=", "f orders_with_items"),
        ("payment orders", "p orders", "=", "f orders"),
        ("paid orders have installments", "p installments_n", "=", "p orders"),
        ("low scores are reviews", "m low_score_orders", "<=", "m reviewed_orders"),
    ])


def expect(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that differ from pinned values, in either direction."""
    values = [c for c in expected.columns if c not in keys]
    theirs = expected.select(*keys, *[F.col(c).alias(f"expected_{c}") for c in values], F.lit(True).alias("_expected"))
    ours = df.select(*keys, *values, F.lit(True).alias("_actual"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"expected_{c}")) for c in values],
                  F.col("_actual").eqNullSafe(F.col("_expected")))
    return ours.join(theirs, list(keys), "full").where(~same).select(
        *keys, *[x for c in values for x in (c, f"expected_{c}")],
        F.when(F.col("_actual").isNull(), "missing").when(F.col("_expected").isNull(), "unexpected").otherwise("differs").alias("problem"))


def expect_values(spark: SparkSession, actual: DataFrame, expected: Mapping[str, int | float | str]) -> DataFrame:
    """Pinned headline numbers of a one-row frame, compared as text: (metric, value, expected_value, problem)."""
    tall = _tall(actual, list(expected), "metric", "value", "string")
    pinned = spark.createDataFrame([(k, str(v)) for k, v in expected.items()], "metric string, value string")
    return expect(tall, pinned, ["metric"])
