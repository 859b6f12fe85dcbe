"""Every registered query: (spark, folder of trade tables) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce, wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import measures as ms
from ledgerloom.functions.status import flatten
from ledgerloom.operators import extracts, grain, infer, order_stats, point_in_time, ranking
from ledgerloom.plans import cohorts, experiment, facts, lead_features, marts, order_grain, rollups, segments, staging
from ledgerloom.session import scratch, stage, tasks_for
from ledgerloom.sources import readers, sinks, trade_tables

from .world import HORIZON, WINDOW, World, tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Pairs of an order and a label that one task makes distinct.
PAIR_ROWS = 500_000
FIRST, LAST = "1997-01", "1999-12"
#: The month that the damaged extracts lack.
GAP = "1998-06"
#: Dates of the cohort queries; the leads cover January 2024.
DESIGN = cohorts.CohortDesign(
    name="one-week outcome", learn_from=dt.date(2024, 1, 1), cut=dt.date(2024, 1, 20),
    judge=cohorts.Days(dt.date(2024, 1, 20), dt.date(2024, 1, 23)), seen_to=dt.date(2024, 1, 30), window=7)


def query(build: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(World(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return build


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ------------------------------------------------------------------ sources, sinks, staging
@query
def table_row_counts(w: World) -> DataFrame:
    return readers.row_counts({name: w.table(name) for name in trade_tables.TABLES})


@query
def cost_column_scan(w: World) -> DataFrame:
    """Which tables have a column named after a cost, offer or assignment word, and their rows."""
    tables = {name: w.table(name) for name in trade_tables.TABLES}
    return readers.scan_columns(w.spark, tables).join(readers.row_counts(tables), "table_name")


def _staging_query(role: str) -> None:
    def build(w: World) -> DataFrame:
        return w.staged(role)

    build.__name__ = f"staged_{role}"
    query(build)


for _role in trade_tables.RAW:
    _staging_query(_role)


def _scratch(w: World, name: str) -> str:
    return scratch(w.spark, name)


@query
def csv_round_trip(w: World) -> DataFrame:
    """A raw role with NULLs, written as unordered CSV files and read with its declared schema."""
    path = _scratch(w, "leads-csv")
    sinks.export_csv(w.raw("leads"), path)
    return staging.stage_all({"leads": readers.read_raw(w.spark, path, "leads")})["leads"]


@query
def documented_counts(w: World) -> DataFrame:
    """Arm counts written as one JSON document and read back."""
    path = _scratch(w, "counts")
    counts = experiment.arm_counts(w.rct)
    inferred = F.struct(F.struct(F.col("y_exposed").alias("value")).alias("y_exposed"))
    counts.select(F.to_json(F.struct(F.struct("n_t", "y_t", "n_c", "y_c", "n_exposed").alias("counts"), inferred.alias("inferred")))).write.text(path)
    return readers.read_documented_counts(w.spark, path)


@query
def verified_exports(w: World) -> DataFrame:
    """Each mart written as ordered CSV, read back and compared to the cent."""
    w.keep("mart_orders")
    w.with_cells()
    root = _scratch(w, "exports")
    keys = {"monthly": ["purchase_month"], "category": ["purchase_month", "product_category"],
            "state": ["purchase_month", "customer_state"], "payment": ["purchase_month", "primary_payment_type"]}
    return union([
        sinks.verified_export(w.keep(name), f"{root}/{name}", "gmv_brl", by).select(F.lit(name).alias("extract"), "*")
        for name, by in keys.items()])


@query
def shuffled_export(w: World) -> DataFrame:
    """The state mart written in no order: the same rows and money, and files that don't hold the order claimed for them."""
    mixed = w.keep("state").repartition(3, F.xxhash64("purchase_month", "customer_state"))
    return sinks.verified_export(mixed, _scratch(w, "mixed"), "gmv_brl", claimed=["purchase_month", "customer_state"])


@query
def ranked_score_export(w: World) -> DataFrame:
    """Scores written best first, read back with typed columns, and whether the files hold that order."""
    path = _scratch(w, "scores")
    sinks.export_ranked_scores(trade_tables.ranked_orders(w.spark, w.sf_dir), path, "score", "id")
    back = readers.read_scores(w.spark, path, "id", "label", ["score"])
    placed = sinks.files_in_order(back.withColumn("id", F.col("id").cast("bigint")), [F.desc("score"), F.asc("id")]).first()["in_order"]
    return back.agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum("score").alias("score_sum"),
                    F.countDistinct("id").alias("ids"), F.lit(placed).alias("in_order"))


# ------------------------------------------------------------------ stored layers
#: Buckets that a stored fact has at least, and rows for each.
BUCKETS, BUCKET_ROWS = 4, 1_500_000
STORED_ORDERS = ("order_id", "customer_unique_id", "customer_state", "items_total_brl", "payment_total_brl", "is_delivered_late", "month_label")
STORED_LINES = ("order_id", "product_category", "item_total_brl", "month_label")


def _layer(w: World) -> str:
    """A database of its own in the shared area."""
    name = f"layer_{uuid.uuid4().hex[:12]}"
    w.spark.sql(f"CREATE DATABASE {name} LOCATION '{_scratch(w, name)}'")
    return name


@query
def rebuilt_month(w: World) -> DataFrame:
    """A stored order fact with a stale month (money doubled, a third of its orders missing), of which only that month is replaced: the
    whole table afterwards."""
    label = F.col("month_label")
    orders = w.fct_orders.withColumn("month_label", ms.month_label("purchase_month")).select(*STORED_ORDERS)
    stale = orders.where((label != FIRST) | (F.pmod(F.xxhash64("order_id"), F.lit(3)) > 0)).withColumn(
        "items_total_brl", F.when(label == FIRST, (F.col("items_total_brl") * 2).cast("decimal(22,2)")).otherwise(F.col("items_total_brl").cast("decimal(22,2)")))
    buckets = tasks_for(w.table("orders").count(), BUCKET_ROWS, BUCKETS)
    table = sinks.save_fact(stale, f"{_layer(w)}.fct_orders", "month_label", "order_id", buckets)
    fresh = orders.where(label == FIRST).withColumn("items_total_brl", F.col("items_total_brl").cast("decimal(22,2)"))
    sinks.replace_months(fresh, table, "month_label", "order_id", buckets, [FIRST])
    return w.spark.table(table)


@query
def stored_facts_join(w: World) -> DataFrame:
    """Orders and lines stored in equal buckets, joined and grouped by order without an exchange; a plan that has one is an error.
    A bucket is one task, so there are as many as the lines need."""
    layer, buckets = _layer(w), tasks_for(w.table("lineitem").count(), BUCKET_ROWS, BUCKETS)
    orders = w.fct_orders.withColumn("month_label", ms.month_label("purchase_month")).select(*STORED_ORDERS)
    lines = w.fct_lines.withColumn("month_label", ms.month_label("purchase_month")).select(*STORED_LINES)
    stored = [w.spark.table(sinks.save_fact(df, f"{layer}.{name}", "month_label", "order_id", buckets)) for df, name in ((orders, "fct_orders"), (lines, "fct_lines"))]
    per_order = stored[1].groupBy("order_id").agg(F.count("*").alias("n_lines"), F.sum("item_total_brl").alias("lines_brl"))
    out = stored[0].join(per_order.hint("merge"), "order_id", "left").select(
        "order_id", "month_label", "n_lines", "items_total_brl", "lines_brl", F.col("items_total_brl").eqNullSafe(F.col("lines_brl")).alias("agrees"))
    moved = sinks.exchanges(out)
    if moved:
        raise RuntimeError(f"stored facts are moved again: {moved}")
    return out


@query
def checks_of_a_write(w: World) -> DataFrame:
    """Null counts, totals and domains of the order fact, taken while it is written: one scan for the table and its checks."""
    cents = lambda c: (F.sum(c) * 100)
    checks = {
        "rows": F.count("*"), "null order_id": ms.rows_where(F.col("order_id").isNull()), "null delivered_at": ms.rows_where(F.col("delivered_at").isNull()),
        "null primary_payment_type": ms.rows_where(F.col("primary_payment_type").isNull()), "item cents": cents("items_total_brl"), "payment cents": cents("payment_total_brl"),
        "unaccepted statuses": ms.rows_where(~F.col("order_status").isin("delivered", "canceled")), "late but not delivered": ms.rows_where(F.col("is_delivered_late") & ~F.col("is_delivered")),
        "days since the last order": F.datediff(F.max("purchased_at"), F.max(F.when(F.col("is_in_analysis_window"), F.col("purchased_at")))),
    }
    return sinks.save_checked(w.fct_orders, _scratch(w, "checked"), checks)


# ------------------------------------------------------------------ order grain, dimensions, facts
@query
def items_by_order(w: World) -> DataFrame:
    return w.items_agg


@query
def payments_by_order(w: World) -> DataFrame:
    return w.payments_agg


@query
def reviews_by_order(w: World) -> DataFrame:
    return w.reviews_agg


@query
def zip_centroids(w: World) -> DataFrame:
    return w.centroid


@query
def orders_enriched(w: World) -> DataFrame:
    return w.enriched


@query
def dim_customers(w: World) -> DataFrame:
    return w.people


@query
def dim_geography(w: World) -> DataFrame:
    return facts.dim_geography(w.centroid)


@query
def dim_products(w: World) -> DataFrame:
    return w.products


@query
def dim_sellers(w: World) -> DataFrame:
    return facts.dim_sellers(w.staged("sellers"), w.centroid)


@query
def fct_orders(w: World) -> DataFrame:
    return w.fct_orders


@query
def fct_order_items(w: World) -> DataFrame:
    return w.fct_lines


# ------------------------------------------------------------------ marts and profiles
@query
def monthly_performance(w: World) -> DataFrame:
    return w.monthly


@query
def category_performance(w: World) -> DataFrame:
    return w.category


@query
def state_performance(w: World) -> DataFrame:
    return w.state


@query
def payment_performance(w: World) -> DataFrame:
    return w.payment


@query
def customer_segments(w: World) -> DataFrame:
    w.keep("people")
    return segments.customer_segments(w.people, w.fct_orders)


@query
def segment_profile(w: World) -> DataFrame:
    w.keep("people")
    return segments.segment_profile(segments.customer_segments(w.people, w.fct_orders))


@query
def segment_matrix(w: World) -> DataFrame:
    w.keep("people")
    return segments.score_matrix(segments.customer_segments(w.people, w.fct_orders))


@query
def quintile_evenness(w: World) -> DataFrame:
    """Bucket count and size spread on both axes."""
    w.keep("people")
    scored = segments.customer_segments(w.people, w.fct_orders)
    return union([grain.bucket_spread(scored.groupBy(axis).agg(F.count("*").alias("n")), axis) for axis in ("r_score", "m_score")])


@query
def distributed_ntile(w: World) -> DataFrame:
    """Seven buckets over all order lines by price, without a one-task window."""
    lines = w.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    keys = [("l_extendedprice", False), ("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False)]
    bucket = order_stats.ntile_column(lines, keys, 7)
    return lines.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))


@query
def global_positions(w: World) -> DataFrame:
    """Rank of every order by value, best first, ties by id."""
    orders = w.table("orders").select("o_orderkey", "o_totalprice")
    return order_stats.with_position(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query
def frequency_distribution(w: World) -> DataFrame:
    return marts.frequency_distribution(w.staged("orders"), w.staged("customers"))


@query
def frequency_headline(w: World) -> DataFrame:
    return marts.frequency_headline(w.staged("orders"), w.staged("customers"))


@query
def status_profile(w: World) -> DataFrame:
    return marts.status_profile(w.staged("orders"))


@query
def order_date_range(w: World) -> DataFrame:
    return marts.date_range(w.staged("orders"))


@query
def money_gap(w: World) -> DataFrame:
    return marts.money_gap(w.items_agg, w.payments_agg)


@query
def multi_category_orders(w: World) -> DataFrame:
    return marts.multi_label_orders(w.fct_lines, tasks=tasks_for(w.table("lineitem").count(), PAIR_ROWS, least=4))


@query
def payment_mix(w: World) -> DataFrame:
    return marts.payment_mix(w.staged("order_payments"))


@query
def gap_flags(w: World) -> DataFrame:
    """How many orders lack items, payment or review, inside and outside the analysis window."""
    return w.fct_orders.groupBy("is_in_analysis_window").agg(
        F.count("*").alias("orders"), *[ms.rows_where(c).alias(c) for c in ("has_no_items", "has_no_payment", "has_no_review")],
        ms.rows_where("customer_zip_not_geocoded").alias("not_geocoded"))


@query
def monthly_share_by_region(w: World) -> DataFrame:
    """A lookup chain to region names, and each region's share of a month's order value."""
    nation = w.table("nation").join(w.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = w.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    cents = F.col("o_totalprice").cast("decimal(14,2)")
    sums = w.table("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        ms.month_start("o_orderdate").alias("purchase_month"), F.col("r_name").alias("region")).agg(F.sum(cents).alias("value_brl"))
    whole = F.sum("value_brl").over(Window.partitionBy("purchase_month"))
    return sums.withColumn("pct_of_month", ms.percent("value_brl", whole))


# ------------------------------------------------------------------ data contracts
@query
def null_counts(w: World) -> DataFrame:
    return grain.null_counts(w.fct_orders, ["order_id", "customer_unique_id", "delivered_at", "items_total_brl", "primary_payment_type", "avg_review_score"])


@query
def duplicate_line_keys(w: World) -> DataFrame:
    """Order lines whose supposed key repeats."""
    return grain.unique_combination(w.staged("order_items"), ["order_id", "order_item_seq"])


@query
def grain_probe_lines(w: World) -> DataFrame:
    return grain.probe_grain(w.staged("order_items"), [["order_id"], ["order_id", "order_item_seq"], ["order_id", "order_item_seq", "product_id", "seller_id"]])


@query
def grain_probe_spine(w: World) -> DataFrame:
    return grain.probe_grain(w.staged("orders"), [["order_id"], ["customer_id"]])


@query
def unaccepted_statuses(w: World) -> DataFrame:
    """Statuses outside a short list, as the check reports them."""
    return grain.accepted_values(w.staged("orders"), "order_status", ["delivered", "canceled"])


@query
def orphan_lookup_keys(w: World) -> DataFrame:
    """Product categories that the lookup does not translate."""
    return grain.relationships(w.staged("products"), "product_category_pt", w.staged("product_categories"), "product_category_pt")


@query
def missing_children(w: World) -> DataFrame:
    return grain.missing_children(w.staged("orders"), "order_id", {r: w.staged(r) for r in ("order_items", "order_payments", "order_reviews")})


@query
def fanout_report(w: World) -> DataFrame:
    """The damage of joining orders straight to items, payments and reviews."""
    children = {r: w.staged(f"order_{r}") for r in ("items", "payments", "reviews")}
    return grain.fanout_report(w.staged("orders"), children, "order_id", {"items": "item_total_brl", "payments": "payment_value_brl"})


@query
def lead_deal_coverage(w: World) -> DataFrame:
    return grain.join_coverage(w.staged("leads"), w.staged("closed_deals"), "mql_id")


@query
def seller_event_coverage(w: World) -> DataFrame:
    """Buyers with events: user ids matched against accounts."""
    events = w.table("events").select(F.col("user_id").alias("customer_id"))
    return grain.join_coverage(w.staged("customers"), events, "customer_id")


@query
def equal_rowcounts(w: World) -> DataFrame:
    return grain.equal_rowcount(w.staged("orders"), w.enriched)


@query
def fanout_hot_keys(w: World) -> DataFrame:
    """The same for all orders, lines and payments on three keys: products of counts far beyond any real join."""
    few = lambda role: w.staged(role).withColumn("order_id", F.col("order_id").cast("bigint") % 3)
    children = {"items": few("order_items"), "payments": few("order_payments")}
    return grain.fanout_report(few("orders"), children, "order_id", {"items": "item_total_brl", "payments": "payment_value_brl"})


@query
def money_survives(w: World) -> DataFrame:
    items = [("item_price_brl", "items_price_brl"), ("item_freight_brl", "items_freight_brl"), ("item_total_brl", "items_total_brl")]
    return grain.money_survives([(w.staged("order_items"), items), (w.staged("order_payments"), [("payment_value_brl", "payment_total_brl")])], w.enriched)


@query
def facts_agree(w: World) -> DataFrame:
    return grain.facts_agree(w.fct_orders, w.fct_lines)


@query
def metric_layer_reconciles(w: World) -> DataFrame:
    """One scan of the order fact gives the marts (here without their distinct people, which no check reads) and the totals."""
    cells = w.with_cells()
    w.keep("mart_lines")
    return grain.metric_layer_reconciles(cells, w.mart_lines, marts.monthly_sums(cells=cells), w.category, marts.state_sums(cells=cells),
                                         w.payment, ms.in_half_open("purchased_at", *WINDOW))


@query
def additive_components_agree(w: World) -> DataFrame:
    cells = w.with_cells()
    return grain.additive_components_agree(cells, marts.monthly_sums(cells=cells), marts.state_sums(cells=cells), w.payment)


@query
def order_marts_together(w: World) -> DataFrame:
    """The three order marts from one aggregate with grouping sets: every additive cell of each."""
    cells = w.with_cells()
    money = ["gmv_brl", "payment_brl", "freight_brl"]
    return cells.select("grain", "purchase_month", F.col("customer_state").alias("state"), F.col("primary_payment_type").alias("instrument"),
                        "orders", "orders_with_items", "delivered_orders", "late_orders", "review_score_n", "installments_n", *money)


@query
def recency_anchor(w: World) -> DataFrame:
    return w.people.agg(F.min("days_since_last_order").alias("min_days"))


@query
def row_rule_breaches(w: World) -> DataFrame:
    """Lines of the category mart where one order holds several lines, as a breached rule."""
    rules = {"one line per order": F.col("orders") == F.col("order_lines"), "goods and freight make GMV": F.col("goods_brl") + F.col("freight_brl") == F.col("gmv_brl")}
    return grain.row_rules(w.category, rules, ["month_label", "product_category"])


@query
def pinned_expectations(w: World) -> DataFrame:
    """Monthly order counts against counts pinned from the raw table: the months outside the analysis window are missing."""
    pinned = w.table("orders").groupBy(ms.month_label(ms.month_start("o_orderdate")).alias("month_label")).agg(F.count("*").alias("orders"))
    return grain.expect(w.monthly.select("month_label", "orders"), pinned, ["month_label"])


@query
def month_coverage(w: World) -> DataFrame:
    months = w.staged("orders").select(ms.month_start("purchased_at").alias("purchase_month"))
    number = ms.month_number("purchase_month")
    return months.agg(F.countDistinct("purchase_month").alias("months"), (F.max(number) - F.min(number) + 1).alias("month_span"))


@query
def extract_reconciliation(w: World) -> DataFrame:
    """The four exported text tables through typed parse, contract and per-month reconciliation."""
    return extracts.assemble(w.text_extracts(written=False)).reconciliation.select("check_name", "month_label", "result")


@query
def extract_reconciliation_without_components(w: World) -> DataFrame:
    """The same for files without additive components: denominators are inferred, some checks bounded."""
    loaded = extracts.assemble(w.text_extracts(components=False))
    return rollups.status_counts(loaded.reconciliation, ["check_name", "result"])


@query
def extract_violations(w: World) -> DataFrame:
    """Everything the contract finds wrong in well-formed extracts: nothing."""
    return extracts.assemble(w.text_extracts()).violations


@query
def extract_violations_damaged(w: World) -> DataFrame:
    """What the contract finds inside damaged files and in their month lists: a month missing from the monthly file, dates that
    are no first of a month, a month that only one file has, repeated rows, and counts that break a rule.
    (Totals across files have queries of their own.)"""
    texts = w.text_extracts()
    label = F.col("month_label")
    texts["monthly"] = texts["monthly"].where(label != GAP)
    texts["payment"] = texts["payment"].withColumn("purchase_month", F.when(label == LAST, F.lit(f"{LAST}-02")).otherwise(F.col("purchase_month")))
    texts["state"] = texts["state"].withColumns({
        "purchase_month": F.when(label == LAST, F.lit("2031-01-01")).otherwise(F.col("purchase_month")), "month_label": F.when(label == LAST, F.lit("2031-01")).otherwise(label)})
    texts["category"] = union([texts["category"].withColumn("orders", F.when(label == FIRST, F.lit("0")).otherwise(F.col("orders"))), texts["category"].where(label == LAST)])
    return extracts.assemble(texts).violations.where("extract <> 'all'")


@query
def inferred_denominators(w: World) -> DataFrame:
    """Orders with items per state and month, recovered from order value printed to four decimals."""
    w.keep("state")
    printed = F.round("aov_brl", 4).cast("decimal(24,4)").cast("string")
    solved = w.state.withColumn("i", infer.aov_denominator(F.col("gmv_brl").cast("string"), printed, F.col("orders")))
    return solved.select("month_label", "customer_state", F.col("i.value").alias("value"), F.col("i.status").alias("status"), F.col("i.candidates").alias("candidates"), F.col("i.reason").alias("reason"))


@query
def inferred_numerators(w: World) -> DataFrame:
    """Low-score orders per month, recovered from a rate printed to one decimal."""
    w.keep("monthly")
    printed = F.round("low_score_rate_pct", 1).cast("decimal(24,1)").cast("string")
    solved = w.monthly.withColumn("i", infer.infer_numerator(printed, F.col("reviewed_orders")))
    return solved.select("month_label", F.col("i.value").alias("value"), F.col("i.status").alias("status"), F.col("i.candidates").alias("candidates"), F.col("i.reason").alias("reason"))


@query
def typed_parse_of_text(w: World) -> DataFrame:
    """Strict parsing of line columns as text: how many cells are money, counts, numbers."""
    from ledgerloom.functions.text import finite_number, money_cents, whole_count

    texts = union([w.table("lineitem").select(F.col(c).cast("string").alias("t")) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")])
    read = texts.selectExpr(f"{money_cents('t')} AS m", f"{whole_count('t')} AS c", f"{finite_number('t')} AS f")
    return read.agg(F.count("m.value").alias("money"), F.sum("m.value").alias("cents"), F.count("c.value").alias("counts"),
                    F.sum("c.value").alias("count_sum"), F.count("f.value").alias("numbers"), F.count("f.problem").alias("not_numbers"))


# ------------------------------------------------------------------ selection roll-ups
@query
def overview(w: World) -> DataFrame:
    return flatten(rollups.overview(w.rollup_input("monthly"), FIRST, LAST))


@query
def month_selections(w: World) -> DataFrame:
    """Ranges with both ends in the data, with unknown ends and reversed ones."""
    return rollups.selections(w.rollup_input("monthly"), [(FIRST, LAST), (FIRST, FIRST), ("2030-01", "2030-02"), (FIRST, "2030-01"), (LAST, FIRST)])


@query
def category_view_sparse(w: World) -> DataFrame:
    """A month that the data has and the category mart lacks is no error."""
    sparse = w.rollup_input("category").where(F.col("month_label") != FIRST)
    return flatten(rollups.categories(sparse, FIRST, LAST, months=w.rollup_input("monthly")).rows)


@query
def overview_single_month(w: World) -> DataFrame:
    return flatten(rollups.overview(w.rollup_input("monthly"), FIRST, FIRST))


@query
def overview_series(w: World) -> DataFrame:
    return rollups.overview_series(w.rollup_input("monthly"), FIRST, LAST)


@query
def category_view(w: World) -> DataFrame:
    return flatten(rollups.categories(w.rollup_input("category"), FIRST, LAST).rows)


@query
def category_view_search(w: World) -> DataFrame:
    view = rollups.categories(w.rollup_input("category"), FIRST, LAST, search=" LARGE ", sort="freight_share", top=5)
    return flatten(view.rows).select("product_category", "order_lines", "gmv_value", "freight_share_value", "share_of_selected_gmv_value")


@query
def category_totals(w: World) -> DataFrame:
    return flatten(rollups.categories(w.rollup_input("category"), FIRST, LAST, search="large").totals)


@query
def state_view(w: World) -> DataFrame:
    return flatten(rollups.states(w.rollup_input("state"), FIRST, LAST))


@query
def state_view_chosen(w: World) -> DataFrame:
    return flatten(rollups.states(w.rollup_input("state"), FIRST, LAST, ["N01", "N02", "N03"]))


@query
def payment_view(w: World) -> DataFrame:
    return flatten(rollups.payments(w.rollup_input("payment"), FIRST, LAST, ["boleto", "voucher"]))


@query
def decision_totals(w: World) -> DataFrame:
    return rollups.decision_totals(w.rollup_input("monthly"))


@query
def worst_months(w: World) -> DataFrame:
    return rollups.worst_months(w.rollup_input("monthly"))


@query
def freight_extremes(w: World) -> DataFrame:
    return rollups.freight_extremes(w.rollup_input("state"))


@query
def inference_status_counts(w: World) -> DataFrame:
    """Outcomes of all inferences, over the extracts that have a column to recover: no line and no category is needed for them."""
    log = extracts.inferences(w.text_extracts(components=False, names=extracts.RECOVERABLE))
    return rollups.status_counts(log, ["extract", "field", "status"])


# ------------------------------------------------------------------ leads
@query
def lead_features_table(w: World) -> DataFrame:
    return w.leads


@query
def lead_contract(w: World) -> DataFrame:
    return grain.lead_label_contract(w.leads, HORIZON)


@query
def lead_contract_damaged(w: World) -> DataFrame:
    """The same with some labels turned over, some maturity dates a day late, some counts that include the lead."""
    turn = F.col("mql_id").cast("bigint") % 97
    damaged = w.leads.withColumns({
        "is_won": F.when(turn == 0, ~F.col("is_won")).otherwise(F.col("is_won")),
        "label_mature_on": F.when(turn == 1, F.date_add("label_mature_on", 1)).otherwise(F.col("label_mature_on")),
        "page_lead_volume_prior": F.when((turn == 2) & F.col("page_lead_volume").isNotNull(), F.col("page_lead_volume")).otherwise(F.col("page_lead_volume_prior"))})
    return grain.lead_label_contract(damaged, HORIZON)


@query
def prior_counts_agree(w: World) -> DataFrame:
    """The running-day count against a range window over rows."""
    both = point_in_time.prior_count_by_range(w.leads, "landing_page_id", "first_contact_date", "again")
    return cohorts.column_disagreements(both, F.col("page_lead_volume_prior"), F.col("again"))


@query
def conversion_by_cohort(w: World) -> DataFrame:
    return marts.conversion_by_cohort(w.leads)


@query
def conversion_by_channel(w: World) -> DataFrame:
    return marts.conversion_by_channel(w.leads)


@query
def win_lag_distribution(w: World) -> DataFrame:
    return marts.lag_distribution(w.leads)


@query
def landing_page_cardinality(w: World) -> DataFrame:
    return marts.key_cardinality(w.staged("leads"), "landing_page_id")


@query
def cohort_labels(w: World) -> DataFrame:
    """Both cohorts of a design: size, positives, immature labels."""
    parts = []
    for name, cohort, known in (("train", DESIGN.training(w.leads), DESIGN.cut), ("score", DESIGN.scoring(w.leads), DESIGN.cut)):
        mature_on = F.date_add("first_contact_date", DESIGN.window + 1)
        parts.append(cohort.agg(F.count("*").alias("leads"), F.sum("label").alias("positives"), F.count_if(mature_on > F.lit(known)).alias("immature"))
                     .select(F.lit(name).alias("cohort"), "leads", "positives", "immature"))
    return union(parts)


@query
def split_audit(w: World) -> DataFrame:
    return lead_features.audit_split(w.leads, "2024-01-01", "2024-01-15", "2024-01-16", 7)


@query
def design_matrix(w: World) -> DataFrame:
    return lead_features.design_matrix(w.leads).select("mql_id", "channel", "log_page_volume", "contact_weekday", "is_weekend")


@query
def channel_baselines(w: World) -> DataFrame:
    train = lead_features.design_matrix(DESIGN.training(w.leads))
    score = lead_features.design_matrix(DESIGN.scoring(w.leads))
    return cohorts.baselines(train, score).select("mql_id", "label", "score_base", "score_channel")


@query
def encoder_moments(w: World) -> DataFrame:
    """Population moments of the numeric inputs on the training cohort."""
    train = lead_features.design_matrix(DESIGN.training(w.leads))
    return train.agg(*[f(c).alias(f"{n}_{c}") for c in lead_features.NUMERIC_FEATURES for f, n in ((F.avg, "mean"), (F.stddev_pop, "spread"))])


@query
def lead_model_metrics(w: World) -> DataFrame:
    """Both baselines and both fitted models, with all their rounds, evaluated on the scoring cohort."""
    w.keep("leads")
    return cohorts.run_design(w.leads, DESIGN).metrics


@query
def lead_baseline_metrics(w: World) -> DataFrame:
    """The part of the evaluation that needs no fitted model: the overall and the channel rate as scores."""
    train, score = (lead_features.design_matrix(x) for x in (DESIGN.training(w.leads), DESIGN.scoring(w.leads)))
    scored, _ = stage(cohorts.baselines(train, score).select("mql_id", "label", "score_base", "score_channel"), "baselines")
    return ranking.evaluate_scores(scored, ["score_base", "score_channel"], "mql_id", "label").select(
        "model", "n", "positives", "prevalence", "mean_score", "brier", "auc")


@query
def lead_model_weights(w: World) -> DataFrame:
    w.keep("leads")
    return cohorts.run_design(w.leads, DESIGN, boosted=False).weights


@query
def lead_model_evidence(w: World) -> DataFrame:
    """What must hold of any fit: trees rank no worse than the overall rate and within a band of the channel rates, and a logistic fit
    with a free intercept predicts the base rate on average over its training rows. The band is 0.15, or two standard errors of the
    AUC of scores without skill where the judged cohort is too small to tell less apart."""
    w.keep("leads")
    run = cohorts.run_design(w.leads, DESIGN, rounds=20)
    auc = {r["model"]: r["auc"] for r in run.metrics.select("model", "auc").collect()}
    n, won = run.summary["score_n"], run.summary["score_positives"]
    band = max(0.15, 2 * math.sqrt((n + 1) / (12 * won * (n - won)))) if 0 < won < n else 1.0
    fitted = cohorts.positive_probability(run.logistic, run.inputs, "p").agg(
        F.count("*").alias("training_rows"), (F.abs(F.avg("p") - F.avg("label")) < 1e-6).alias("mean_is_base_rate"))
    return fitted.withColumns({"trees_beat_constant": F.lit(auc["score_gb"] > 0.4), "trees_near_channels": F.lit(abs(auc["score_gb"] - auc["score_channel"]) < band),
                               "constant_has_no_skill": F.lit(auc["score_base"] == 0.5)})


@query
def encoded_leads(w: World) -> DataFrame:
    """The sparse inputs of the models, made dense: indicator columns of all channels but the first, and the number of scaled ones."""
    train = lead_features.design_matrix(DESIGN.training(w.leads))
    encoder = cohorts.fit_encoder(train)
    wide = encoder.n_levels - 1
    dense = vector_to_array("features")
    return encoder.transform(train).select(
        "mql_id", "channel", F.array_join(F.transform(F.slice(dense, 1, wide), lambda x: x.cast("int").cast("string")), "").alias("indicators"),
        F.size(dense).cast("bigint").alias("width"), F.round(F.element_at(dense, wide + 1), 6).alias("first_number"))


@query
def design_problems(w: World) -> DataFrame:
    """What is wrong with designs that can't be run, and how each describes itself; the first is sound."""
    day = dt.date
    broken = {"sound": {}, "labels not settled": {"learn_to": day(2024, 1, 19)}, "judged before the cut": {"judge": cohorts.Days(day(2024, 1, 15), day(2024, 1, 23))},
              "outcomes not seen": {"seen_to": day(2024, 1, 24)}, "unknown features": {"features": "x"}, "nobody to judge": {"judge": cohorts.Days(day(2024, 1, 23), day(2024, 1, 21))}}
    rows = []
    for name, change in broken.items():
        design = replace(DESIGN, **change)
        rows.append((name, len(design.problems()), str(design.learn), design.settled, str(design.judge)))
    told = w.spark.createDataFrame(rows, "design string, n_problems bigint, learned_from string, settled date, judged_on string")
    sizes = union([w.leads.where(F.col("first_contact_date").between(F.lit(d.judge.first), F.lit(d.judge.last))).agg(F.count("*").alias("leads")).select(F.lit(n).alias("design"), "leads")
                   for n, d in ((n, replace(DESIGN, **c)) for n, c in broken.items())])
    return told.join(sizes, "design")


@query
def month_gaps(w: World) -> DataFrame:
    """Months on both sides of each gap, after the orders of three months are taken out."""
    months = w.staged("orders").select(ms.month_start("purchased_at").alias("purchase_month"))
    return grain.month_gaps(months.where(~ms.month_label("purchase_month").isin("1996-03", GAP, "1998-07")))


@query
def lead_model_is_optimal(w: World) -> DataFrame:
    """The fitted logistic weights are where the gradient of the penalised loss is zero."""
    w.keep("leads")
    run = cohorts.run_design(w.leads, DESIGN, boosted=False)
    return cohorts.penalised_gradient(run.inputs, run.logistic).select(
        F.col("n").alias("training_rows"), (F.col("largest") < 1e-5 * F.col("n")).alias("gradient_is_zero"))


# ------------------------------------------------------------------ score rankings
@query
def score_steps(w: World) -> DataFrame:
    return ranking.score_steps(trade_tables.ranked_orders(w.spark, w.sf_dir))


@query
def ranking_quality(w: World) -> DataFrame:
    return ranking.evaluate(trade_tables.ranked_orders(w.spark, w.sf_dir)).drop("top_k")


@query
def ranking_quality_documents(w: World) -> DataFrame:
    return ranking.evaluate(trade_tables.ranked_documents(w.spark, w.sf_dir))


@query
def top_hundred(w: World) -> DataFrame:
    return ranking.top_k(trade_tables.ranked_orders(w.spark, w.sf_dir), 100)


@query
def constant_score_top(w: World) -> DataFrame:
    """Everything tied: expected hits are the base rate times k."""
    flat = trade_tables.ranked_orders(w.spark, w.sf_dir).withColumn("score", F.lit(0.5))
    return ranking.top_k(flat, 500)


@query
def model_comparison(w: World) -> DataFrame:
    """Three stored scores of orders and of documents (one of them reversed, one all ties), each population from one sort of all its scores."""
    parts = []
    for name, ranked in (("orders", trade_tables.ranked_orders), ("documents", trade_tables.ranked_documents)):
        scored = ranked(w.spark, w.sf_dir).withColumns({"reversed": 1 - F.col("score"), "flat": F.lit(0.5)})
        parts.append(ranking.evaluate_scores(scored, ["score", "reversed", "flat"], "id", "label").select(F.lit(name).alias("population"), "*"))
    return union(parts)


@query
def cumulative_gains(w: World) -> DataFrame:
    return ranking.gains(ranking.score_steps(trade_tables.ranked_orders(w.spark, w.sf_dir)))


@query
def decile_lift(w: World) -> DataFrame:
    return ranking.lift_at(trade_tables.ranked_orders(w.spark, w.sf_dir))


# ------------------------------------------------------------------ randomised experiment
@query
def arm_counts(w: World) -> DataFrame:
    return experiment.arm_counts(w.rct, ["segment"])


@query
def experiment_readout(w: World) -> DataFrame:
    """Every statistic but the tail areas, per year."""
    return experiment.analyse(w.rct, ["segment"]).drop("problems", "warnings", "p_value", "log10_p")


@query
def experiment_feasibility(w: World) -> DataFrame:
    """Counts that no experiment can have, boundary and small cells, made from the real arm counts per segment."""
    counts = experiment.arm_counts(w.rct, ["segment"])
    cases = {"as counted": {}, "too many": {"y_t": F.col("n_t") + 1}, "below zero": {"n_c": F.lit(-1).cast("bigint")}, "no count": {"y_exposed": F.lit(None).cast("bigint")},
             "none converted": {"y_c": F.lit(0).cast("bigint")}, "few converted": {"y_c": F.lit(3).cast("bigint")}, "no arm": {"n_c": F.lit(0).cast("bigint"), "y_c": F.lit(0).cast("bigint")}}
    damaged = union([counts.withColumns({c: v for c, v in change.items()}).withColumn("case", F.lit(name)) for name, change in cases.items()])
    out = experiment.analyse_counts(damaged)
    return out.select("segment", "case", "status", "itt_ci_status", F.array_join("problems", "; ").alias("problems"), F.array_join("warnings", "; ").alias("warnings"))


@query
def experiment_p_values(w: World) -> DataFrame:
    return experiment.analyse(w.rct, ["segment"]).select("segment", "z", "p_value", "log10_p")


@query
def experiment_overall(w: World) -> DataFrame:
    return experiment.analyse(w.rct).select("n_t", "y_t", "n_c", "y_c", "itt", "itt_low", "itt_high", "cace", "cace_low", "cace_high")


@query
def covariate_balance(w: World) -> DataFrame:
    return experiment.balance(w.rct, ["f0", "f1"], ["segment"])


@query
def arm_descriptives(w: World) -> DataFrame:
    return experiment.arm_descriptives(w.rct, ["f0", "f1"])


@query
def breakeven_values(w: World) -> DataFrame:
    return experiment.breakeven(experiment.analyse(w.rct, ["segment"]), 2.0).select(
        "segment", "incremental_per_1000", "breakeven_value", "breakeven_best", "breakeven_worst")


@query
def breakeven_exposed_basis(w: World) -> DataFrame:
    return experiment.breakeven_net(experiment.analyse(w.rct, ["segment"]), 100.0, 5.0, "exposed").select(
        "segment", "cost_per_1000_assigned", "net_per_1000", "net_low", "net_high", "breakeven_value")


@query
def exposure_trap(w: World) -> DataFrame:
    """Assignment effect, the naive exposed-against-control difference, and the unexposed check."""
    out = experiment.analyse(w.rct)
    return out.select("itt", "relative_lift", "naive_diff", "naive_relative", "never_taker_rate", "never_taker_gap",
                      (F.col("naive_relative") / F.col("relative_lift")).alias("overstatement"))
