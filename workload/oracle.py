"""ANSI SQL (as DuckDB runs it) that each registered query must agree with, written against the raw
trade tables and independent of the plans."""

from __future__ import annotations

import math
from statistics import NormalDist

from .queries import DESIGN, FIRST, GAP, LAST
from .world import HORIZON, SCOPE_FROM, WINDOW

SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------- building blocks
BLOCKS: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text


def build(body: str) -> str:
    """Puts the blocks a statement mentions (as ``@name``) in front of it, in dependency order."""
    done: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if f"@{name}@" in text and name not in done:
                visit(BLOCKS[name])
                if name not in done:
                    done.append(name)

    visit(body)
    parts = [f"{name} AS ({BLOCKS[name]})" for name in done]
    text = (f"WITH {', '.join(parts)} " if parts else "") + body
    for name in BLOCKS:
        text = text.replace(f"@{name}@", name)
    return text


def oracle(name: str, body: str) -> None:
    SQL[name] = build(body)


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def money(expression: str, name: str) -> str:
    return f"CAST({expression} AS DECIMAL(38,2)) AS {name}"


def share(num: str, den: str) -> str:
    return f"100.0 * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)"


def zip_of(nation: str, balance: str) -> str:
    return f"lpad(CAST({nation} AS VARCHAR), 2, '0') || lpad(CAST(CAST(floor(({balance} + 1000) / 1000) AS INTEGER) AS VARCHAR), 3, '0')"


def state_of(nation: str) -> str:
    return f"'N' || lpad(CAST({nation} AS VARCHAR), 2, '0')"


block("o", """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS purchased_at,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'canceled' ELSE 'shipped' END AS order_status,
  CASE WHEN o_orderstatus <> 'O' AND o_orderpriority <> '4-NOT SPECIFIED'
       THEN o_orderdate + to_days(CAST(CAST(floor(o_totalprice) AS BIGINT) % 31 AS INTEGER)) END AS delivered_at,
  o_orderdate + INTERVAL 20 DAY AS promised_at FROM orders""")
block("li", """SELECT l_orderkey AS order_id, l_linenumber AS seq, l_partkey AS product_id, l_suppkey AS seller_id, l_shipdate AS limit_at,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS DECIMAL(12,2)) AS freight,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_quantity AS DECIMAL(12,2)) AS DECIMAL(14,2)) AS total FROM lineitem""")
block("pay", """SELECT l_orderkey AS order_id, l_linenumber AS seq,
  CASE l_returnflag WHEN 'A' THEN 'boleto' WHEN 'N' THEN 'credit_card' ELSE 'voucher' END AS payment_type,
  CAST(floor(l_quantity) AS INTEGER) % 10 + 1 AS installments, CAST(l_extendedprice AS DECIMAL(12,2)) AS paid
  FROM lineitem WHERE l_linestatus = 'F'""")
block("rev", """SELECT l_partkey AS review_id, l_orderkey AS order_id, CAST(round(l_discount * 100) AS INTEGER) % 5 + 1 AS score,
  l_shipdate AS created_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 3 DAY END AS answered_at
  FROM lineitem WHERE l_returnflag = 'R'""")
block("cust", f"""SELECT c_custkey AS customer_id, c_custkey // 2 AS person, {zip_of('c_nationkey', 'c_acctbal')} AS zip,
  lower(c_mktsegment) AS city, {state_of('c_nationkey')} AS state FROM customer""")
block("pt", f"""SELECT {zip_of('c_nationkey', 'c_acctbal')} AS zip, c_acctbal / 100 AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lng,
  lower(c_mktsegment) AS city, {state_of('c_nationkey')} AS state FROM customer""")
block("prod", """SELECT p_partkey AS product_id, p_name, p_size, p_type,
  CASE WHEN p_type <> 'ECONOMY' THEN lower(p_type) || '_' || split_part(p_brand, '#', 2) END AS cat_pt FROM part""")
block("lookup", "SELECT DISTINCT cat_pt, 'en_' || cat_pt AS cat_en FROM @prod@ WHERE p_type NOT IN ('PROMO', 'ECONOMY')")
block("sell", f"""SELECT s_suppkey AS seller_id, {zip_of('s_nationkey', 's_acctbal')} AS zip, lower(s_name) AS city, {state_of('s_nationkey')} AS state FROM supplier""")
block("lead", """SELECT event_id AS mql_id, CAST(ts AS DATE) AS contact, json_extract_string(props, '$.k') AS page,
  CASE user_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'email' WHEN 2 THEN 'organic' WHEN 3 THEN 'paid_search' END AS origin
  FROM events WHERE event_type = 'signup'""")
block("deal", """SELECT event_id AS mql_id, ts + to_days(CAST(floor(value) AS INTEGER) - 2) AS won_at, value FROM events
  WHERE event_type = 'signup' AND value >= 5""")
block("rct", """SELECT CASE WHEN o_orderkey % 20 < 17 THEN 1 ELSE 0 END AS treatment, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS conversion,
  CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS visit,
  CASE WHEN o_orderkey % 20 < 17 AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS exposure,
  o_totalprice / 1000 AS f0, CAST(dayofyear(o_orderdate) AS DOUBLE) AS f1, year(o_orderdate) AS segment FROM orders""")
block("sc", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, floor(o_totalprice / 4000) / 200 AS score FROM orders""")
block("scd", """SELECT l.doc_id AS id, l.quality AS label, ((d.n_chars * 200) // (d.n_chars + 2000)) / 200 AS score
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")

# order grain
block("ia", """SELECT order_id, count(*) AS n, count(DISTINCT seller_id) AS sellers, count(DISTINCT product_id) AS products,
  sum(price) AS price, sum(freight) AS freight, sum(total) AS total FROM @li@ GROUP BY order_id""")
block("pa", """SELECT p.order_id, sum(p.paid) AS paid, count(*) AS n, count(DISTINCT p.payment_type) AS types, max(p.installments) AS inst,
  (SELECT b.payment_type FROM (SELECT order_id, payment_type, sum(paid) AS v FROM @pay@ GROUP BY ALL) b
   WHERE b.order_id = p.order_id ORDER BY b.v DESC, b.payment_type LIMIT 1) AS primary_type
  FROM @pay@ p GROUP BY p.order_id""")
block("ra", """SELECT order_id, count(*) AS n, avg(score) AS mean_score,
  last(score ORDER BY answered_at NULLS FIRST, created_at NULLS FIRST, review_id, score) AS latest FROM @rev@ GROUP BY order_id""")
block("cen", """SELECT a.zip, a.lat, a.lng, b.city, b.state, a.n FROM
  (SELECT zip, median(lat) AS lat, median(lng) AS lng, count(*) AS n FROM @pt@ GROUP BY zip) a
  JOIN (SELECT zip, city, state FROM (SELECT zip, city, state, count(*) AS k FROM @pt@ GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY zip ORDER BY k DESC, city, state) = 1) b ON b.zip = a.zip""")
block("fo", f"""SELECT o.order_id, o.customer_id, c.person, c.zip, c.city, c.state, o.order_status, o.purchased_at, o.delivered_at,
  CAST(date_trunc('month', o.purchased_at) AS DATE) AS month,
  ia.n AS items, ia.sellers, ia.products, ia.price, ia.freight, ia.total, pa.paid, pa.n AS payments, pa.types, pa.inst, pa.primary_type,
  ra.n AS reviews, ra.mean_score, ra.latest,
  date_diff('day', o.purchased_at, o.delivered_at) AS days, date_diff('day', o.promised_at, o.delivered_at) AS delay,
  coalesce(o.order_status = 'delivered' AND date_diff('day', o.promised_at, o.delivered_at) > 0, false) AS is_late,
  o.order_status = 'delivered' AS is_delivered, o.order_status = 'canceled' AS is_canceled,
  ia.order_id IS NULL AS no_items, pa.order_id IS NULL AS no_payment, ra.order_id IS NULL AS no_review,
  o.purchased_at >= TIMESTAMP '{WINDOW[0]}' AND o.purchased_at < TIMESTAMP '{WINDOW[1]}' AS in_window
  FROM @o@ o LEFT JOIN @cust@ c ON c.customer_id = o.customer_id LEFT JOIN @ia@ ia ON ia.order_id = o.order_id
  LEFT JOIN @pa@ pa ON pa.order_id = o.order_id LEFT JOIN @ra@ ra ON ra.order_id = o.order_id""")
block("dp", """SELECT p.product_id, p.cat_pt, l.cat_en, coalesce(l.cat_en, p.cat_pt, 'unknown') AS category, p.cat_pt IS NULL AS no_category,
  p.cat_pt IS NOT NULL AND l.cat_en IS NULL AS untranslated, p.p_size FROM @prod@ p LEFT JOIN @lookup@ l ON l.cat_pt = p.cat_pt""")
block("fl", f"""SELECT i.*, c.person, c.state, o.purchased_at, o.order_status, CAST(date_trunc('month', o.purchased_at) AS DATE) AS month,
  p.category, p.cat_en, p.no_category, p.untranslated,
  o.purchased_at >= TIMESTAMP '{WINDOW[0]}' AND o.purchased_at < TIMESTAMP '{WINDOW[1]}' AS in_window
  FROM @li@ i JOIN @o@ o ON o.order_id = i.order_id LEFT JOIN @cust@ c ON c.customer_id = o.customer_id LEFT JOIN @dp@ p ON p.product_id = i.product_id""")
block("ppl", """SELECT a.*, b.state, b.city, b.zip, date_diff('day', a.last_at, (SELECT max(purchased_at) FROM @o@)) AS recency FROM
  (SELECT person, count(*) AS n, min(purchased_at) AS first_at, max(purchased_at) AS last_at, sum(paid) AS paid, CAST(sum(paid) AS DOUBLE) / nullif(count(paid), 0) AS avg_paid
   FROM @fo@ GROUP BY person) a
  JOIN (SELECT person, state, city, zip FROM @fo@ QUALIFY row_number() OVER (PARTITION BY person ORDER BY purchased_at DESC, customer_id) = 1) b
  ON b.person = a.person""")

# marts, with measures under plain names
block("mm", """SELECT month, strftime(month, '%Y-%m') AS label, count(*) AS orders, count(DISTINCT person) AS people, sum(total) AS gmv, sum(price) AS goods,
  sum(freight) AS freight, sum(paid) AS paid, count(*) FILTER (NOT no_items) AS owi, count(*) FILTER (is_canceled) AS canceled,
  count(*) FILTER (is_delivered) AS delivered, count(*) FILTER (is_late) AS late, count(*) FILTER (NOT no_review) AS reviewed,
  count(*) FILTER (latest <= 2) AS low, sum(days) FILTER (is_delivered) AS days_sum, count(days) FILTER (is_delivered) AS days_n,
  count(*) FILTER (is_delivered AND delivered_at IS NULL) AS undated, sum(mean_score) AS score_sum, count(mean_score) AS score_n,
  sum(items) AS items_sum, count(items) AS items_n, sum(inst) AS inst_sum, count(inst) AS inst_n,
  count(*) FILTER (primary_type IS NULL) AS x_orders, count(*) FILTER (primary_type IS NULL AND NOT no_items) AS x_owi,
  coalesce(sum(total) FILTER (primary_type IS NULL), 0) AS x_gmv, coalesce(sum(paid) FILTER (primary_type IS NULL), 0) AS x_paid
  FROM @fo@ WHERE in_window GROUP BY month""")
block("mc", """SELECT month, strftime(month, '%Y-%m') AS label, category, count(*) AS lines, count(DISTINCT order_id) AS orders, count(DISTINCT person) AS people,
  count(DISTINCT product_id) AS products, count(DISTINCT seller_id) AS sellers, sum(total) AS gmv, sum(price) AS goods, sum(freight) AS freight,
  avg(CAST(total AS DOUBLE)) AS line_value, count(*) FILTER (no_category) AS x_category, count(*) FILTER (untranslated) AS x_translation
  FROM @fl@ WHERE in_window GROUP BY month, category""")
block("ms", """SELECT month, strftime(month, '%Y-%m') AS label, state, count(*) AS orders, count(DISTINCT person) AS people, sum(total) AS gmv, sum(freight) AS freight,
  count(*) FILTER (NOT no_items) AS owi, count(*) FILTER (is_delivered) AS delivered, count(*) FILTER (is_late) AS late,
  sum(days) FILTER (is_delivered) AS days_sum, count(days) FILTER (is_delivered) AS days_n, sum(mean_score) AS score_sum, count(mean_score) AS score_n
  FROM @fo@ WHERE in_window GROUP BY month, state""")
block("mp", """SELECT month, strftime(month, '%Y-%m') AS label, primary_type, count(*) AS orders, sum(paid) AS paid, sum(total) AS gmv,
  count(*) FILTER (NOT no_items) AS owi, count(*) FILTER (inst > 1) AS split, sum(inst) AS inst_sum, count(inst) AS inst_n
  FROM @fo@ WHERE in_window AND primary_type IS NOT NULL GROUP BY month, primary_type""")
block("lf", f"""SELECT l.mql_id, l.contact, l.page, coalesce(l.origin, 'not_recorded') AS channel, d.mql_id IS NOT NULL AS ever,
  date_diff('day', l.contact, CAST(d.won_at AS DATE)) AS lag, CAST(d.won_at AS DATE) AS won_date,
  (SELECT count(*) FROM @lead@ x WHERE x.page = l.page AND x.contact < l.contact) AS prior_n,
  CASE WHEN l.page IS NOT NULL THEN (SELECT count(*) FROM @lead@ x WHERE x.page = l.page) END AS page_n,
  coalesce(date_diff('day', l.contact, CAST(d.won_at AS DATE)) BETWEEN 0 AND {HORIZON}, false) AS won
  FROM @lead@ l LEFT JOIN @deal@ d ON d.mql_id = l.mql_id""")

# ---------------------------------------------------------------------------- sources, staging
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES)
oracle("table_row_counts", _COUNTS)
_WORDS = ("cost", "spend", "budget", "campaign", "offer", "discount", "promo", "coupon", "treatment", "control", "ab_", "variant")
_HIT = " OR ".join(f"contains(lower(column_name), '{w}')" for w in _WORDS)
_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE SELECT * FROM {t})" for t in _TABLES)
oracle("cost_column_scan", f"""SELECT table_name, count(*) AS n_columns, count(*) FILTER ({_HIT}) AS n_hits, any_value(n_rows) AS n_rows
  FROM ({_COLUMNS}) JOIN ({_COUNTS}) USING (table_name) GROUP BY table_name""")
oracle("staged_orders", """SELECT order_id, customer_id, order_status, purchased_at, purchased_at AS approved_at,
  purchased_at + INTERVAL 2 DAY AS handed_to_carrier_at, delivered_at, promised_at AS estimated_delivery_at,
  date_diff('day', promised_at, delivered_at) AS delivery_days_vs_estimate FROM @o@""")
oracle("staged_order_items", f"""SELECT order_id, {big('seq', 'order_item_seq')}, product_id, seller_id, limit_at AS shipping_limit_at,
  {money('price', 'item_price_brl')}, {money('freight', 'item_freight_brl')}, {money('total', 'item_total_brl')} FROM @li@""")
oracle("staged_order_payments", f"""SELECT order_id, {big('seq', 'payment_seq')}, payment_type, {big('installments', 'payment_installments')}, {money('paid', 'payment_value_brl')} FROM @pay@""")
oracle("staged_order_reviews", f"""SELECT review_id, order_id, {big('score', 'review_score')}, CAST(NULL AS VARCHAR) AS review_comment_title,
  CAST(NULL AS VARCHAR) AS review_comment_message, created_at AS review_created_at, answered_at AS review_answered_at FROM @rev@""")
oracle("staged_customers", "SELECT customer_id, person AS customer_unique_id, zip AS customer_zip_prefix, city AS customer_city, state AS customer_state FROM @cust@")
oracle("staged_products", f"""SELECT product_id, cat_pt AS product_category_pt, length(p_name) AS product_name_length, length(p_name) AS product_description_length,
  {big('p_size % 7', 'product_photos_qty')}, {big('p_size * 10', 'product_weight_g')}, {big('p_size', 'product_length_cm')},
  {big('p_size + 1', 'product_height_cm')}, {big('p_size + 2', 'product_width_cm')} FROM @prod@""")
oracle("staged_sellers", "SELECT seller_id, zip AS seller_zip_prefix, city AS seller_city, state AS seller_state FROM @sell@")
oracle("staged_geolocation", f"SELECT zip AS zip_prefix, {r6('lat', 'latitude')}, {r6('lng', 'longitude')}, city, state FROM @pt@")
oracle("staged_product_categories", "SELECT cat_pt AS product_category_pt, cat_en AS product_category_en FROM @lookup@")
oracle("csv_round_trip", "SELECT CAST(mql_id AS VARCHAR) AS mql_id, contact AS first_contact_date, page AS landing_page_id, origin AS lead_origin_channel FROM @lead@")
oracle("staged_leads", "SELECT mql_id, contact AS first_contact_date, page AS landing_page_id, origin AS lead_origin_channel FROM @lead@")
_NONE = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in (
    "sdr_id", "sr_id", "business_segment", "lead_type", "lead_behaviour_profile", "has_company", "has_gtin", "average_stock", "business_type"))
oracle("staged_closed_deals", f"""SELECT mql_id, mql_id AS seller_id, won_at, {_NONE}, {r6('value', 'declared_catalog_size')},
  {r6('value * 10', 'declared_monthly_revenue_brl')} FROM @deal@""")
oracle("verified_exports", " UNION ALL ".join(
    f"""SELECT '{n}' AS extract, count(*) AS rows_meant, count(*) AS rows_found, count(*) - count(gmv) AS nulls_meant, count(*) - count(gmv) AS nulls_found,
    {big('sum(gmv) * 100', 'cents_meant')}, {big('sum(gmv) * 100', 'cents_found')}, true AS in_order, true AS verified FROM @{t}@"""
    for n, t in (("monthly", "mm"), ("category", "mc"), ("state", "ms"), ("payment", "mp"))))
oracle("shuffled_export", f"""SELECT count(*) AS rows_meant, count(*) AS rows_found, count(*) - count(gmv) AS nulls_meant, count(*) - count(gmv) AS nulls_found,
  {big('sum(gmv) * 100', 'cents_meant')}, {big('sum(gmv) * 100', 'cents_found')}, false AS in_order, true AS verified FROM @ms@""")
oracle("ranked_score_export", f"SELECT count(*) AS n, {big('sum(label)', 'positives')}, {r6('sum(score)', 'score_sum')}, count(DISTINCT id) AS ids, true AS in_order FROM @sc@")

# ---------------------------------------------------------------------------- stored layers
oracle("rebuilt_month", f"""SELECT order_id, person AS customer_unique_id, state AS customer_state, {money('total', 'items_total_brl')}, {money('paid', 'payment_total_brl')},
  is_late AS is_delivered_late, strftime(month, '%Y-%m') AS month_label FROM @fo@""")
oracle("stored_facts_join", f"""SELECT order_id, strftime(month, '%Y-%m') AS month_label, items AS n_lines, {money('total', 'items_total_brl')}, {money('total', 'lines_brl')},
  true AS agrees FROM @fo@""")
oracle("checks_of_a_write", " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST({value} AS BIGINT) AS value FROM @fo@" for name, value in (
    ("rows", "count(*)"), ("null order_id", "count(*) - count(order_id)"), ("null delivered_at", "count(*) - count(delivered_at)"),
    ("null primary_payment_type", "count(*) - count(primary_type)"), ("item cents", "sum(total) * 100"), ("payment cents", "sum(paid) * 100"),
    ("unaccepted statuses", "count(*) FILTER (order_status NOT IN ('delivered', 'canceled'))"), ("late but not delivered", "count(*) FILTER (is_late AND NOT is_delivered)"),
    ("days since the last order", "date_diff('day', max(purchased_at) FILTER (in_window), max(purchased_at))"))))
oracle("order_marts_together", " UNION ALL ".join(
    f"""SELECT '{grain}' AS grain, {month} AS purchase_month, {state} AS state, {kind} AS instrument, count(*) AS orders, count(*) FILTER (NOT no_items) AS orders_with_items,
    count(*) FILTER (is_delivered) AS delivered_orders, count(*) FILTER (is_late) AS late_orders, count(mean_score) AS review_score_n, count(inst) AS installments_n,
    {money('sum(total)', 'gmv_brl')}, {money('sum(paid)', 'payment_brl')}, {money('sum(freight)', 'freight_brl')} FROM @fo@ WHERE in_window {group}"""
    for grain, month, state, kind, group in (
        ("all", "CAST(NULL AS DATE)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", ""), ("month", "month", "NULL", "NULL", "GROUP BY month"),
        ("state", "month", "state", "NULL", "GROUP BY month, state"), ("instrument", "month", "NULL", "primary_type", "GROUP BY month, primary_type"))))

# ---------------------------------------------------------------------------- order grain, dimensions, facts
oracle("items_by_order", f"""SELECT order_id, n AS item_count, sellers AS distinct_sellers, products AS distinct_products,
  {money('price', 'items_price_brl')}, {money('freight', 'items_freight_brl')}, {money('total', 'items_total_brl')} FROM @ia@""")
oracle("payments_by_order", f"""SELECT order_id, {money('paid', 'payment_total_brl')}, n AS payment_count, types AS distinct_payment_types,
  {big('inst', 'max_installments')}, primary_type AS primary_payment_type FROM @pa@""")
oracle("reviews_by_order", f"SELECT order_id, n AS review_count, {r6('mean_score', 'avg_review_score')}, {big('latest', 'latest_review_score')} FROM @ra@")
oracle("zip_centroids", f"SELECT zip AS zip_prefix, {r6('lat', 'latitude')}, {r6('lng', 'longitude')}, city, state, n AS point_count FROM @cen@")
oracle("dim_geography", f"SELECT zip AS zip_prefix, {r6('lat', 'latitude')}, {r6('lng', 'longitude')}, city, state, n AS source_point_count FROM @cen@")
_ORDER_BODY = f"""items AS item_count, sellers AS distinct_sellers, {money('price', 'items_price_brl')}, {money('freight', 'items_freight_brl')},
  {money('total', 'items_total_brl')}, {money('paid', 'payment_total_brl')}, payments AS payment_count, {big('inst', 'max_installments')},
  primary_type AS primary_payment_type, {r6('mean_score', 'avg_review_score')}, {big('latest', 'latest_review_score')}, days AS days_purchase_to_delivery,
  delay AS delivery_days_vs_estimate, is_late AS is_delivered_late, no_items AS has_no_items, no_payment AS has_no_payment, no_review AS has_no_review"""
oracle("orders_enriched", f"""SELECT order_id, customer_id, person AS customer_unique_id, zip AS customer_zip_prefix, city AS customer_city, state AS customer_state,
  order_status, purchased_at, delivered_at, products AS distinct_products, types AS distinct_payment_types, reviews AS review_count,
  purchased_at AS approved_at, purchased_at + INTERVAL 2 DAY AS handed_to_carrier_at, purchased_at + INTERVAL 20 DAY AS estimated_delivery_at, {_ORDER_BODY} FROM @fo@""")
oracle("fct_orders", f"""SELECT order_id, person AS customer_unique_id, purchased_at, CAST(purchased_at AS DATE) AS purchase_date, month AS purchase_month,
  f.state AS customer_state, f.city AS customer_city, {r6('g.lat', 'customer_latitude')}, {r6('g.lng', 'customer_longitude')},
  g.zip IS NULL AS customer_zip_not_geocoded, order_status, is_delivered, is_canceled, delivered_at, in_window AS is_in_analysis_window, {_ORDER_BODY}
  FROM @fo@ f LEFT JOIN @cen@ g ON g.zip = f.zip""")
oracle("dim_customers", f"""SELECT person AS customer_unique_id, state AS customer_state, city AS customer_city, zip AS customer_zip_prefix, n AS order_count,
  n > 1 AS is_repeat_customer, first_at AS first_purchased_at, last_at AS last_purchased_at, {money('paid', 'lifetime_payment_brl')},
  {r6('avg_paid', 'avg_order_payment_brl')}, recency AS days_since_last_order FROM @ppl@""")
oracle("dim_products", f"""SELECT product_id, cat_pt AS product_category_pt, cat_en AS product_category_en, category AS product_category, no_category AS has_no_category,
  untranslated AS missing_translation, {big('p_size % 7', 'product_photos_qty')}, {big('p_size * 10', 'product_weight_g')},
  {big('p_size * (p_size + 1) * (p_size + 2)', 'product_volume_cm3')} FROM @dp@""")
oracle("dim_sellers", f"""SELECT seller_id, s.state AS seller_state, s.city AS seller_city, s.zip AS seller_zip_prefix, {r6('g.lat', 'seller_latitude')},
  {r6('g.lng', 'seller_longitude')}, g.zip IS NULL AS seller_zip_not_geocoded FROM @sell@ s LEFT JOIN @cen@ g ON g.zip = s.zip""")
oracle("fct_order_items", f"""SELECT order_id, {big('seq', 'order_item_seq')}, product_id, seller_id, person AS customer_unique_id, purchased_at,
  CAST(purchased_at AS DATE) AS purchase_date, month AS purchase_month, category AS product_category, cat_en AS product_category_en,
  no_category AS has_no_category, untranslated AS missing_translation, state AS customer_state, order_status, order_status = 'delivered' AS is_delivered,
  {money('price', 'item_price_brl')}, {money('freight', 'item_freight_brl')}, {money('total', 'item_total_brl')} FROM @fl@""")

# ---------------------------------------------------------------------------- marts and profiles
oracle("monthly_performance", f"""SELECT month AS purchase_month, label AS month_label, orders, people AS active_customers, {money('gmv', 'gmv_brl')},
  {money('goods', 'goods_brl')}, {money('freight', 'freight_brl')}, {money('paid', 'payment_brl')}, owi AS orders_with_items,
  {r6('CAST(gmv AS DOUBLE) / nullif(owi, 0)', 'aov_brl')}, canceled AS canceled_orders, {r6(share('canceled', 'orders'), 'cancel_rate_pct')},
  delivered AS delivered_orders, late AS late_orders, {r6(share('late', 'delivered'), 'late_delivery_rate_pct')},
  {r6('CAST(days_sum AS DOUBLE) / nullif(days_n, 0)', 'avg_delivery_days')}, reviewed AS reviewed_orders,
  {r6('score_sum / nullif(score_n, 0)', 'avg_review_score')}, {r6(share('low', 'reviewed'), 'low_score_rate_pct')},
  {r6('CAST(items_sum AS DOUBLE) / nullif(items_n, 0)', 'avg_items_per_order')}, {r6('CAST(inst_sum AS DOUBLE) / nullif(inst_n, 0)', 'avg_installments')},
  low AS low_score_orders, {big('days_sum', 'delivery_days_sum')}, days_n AS delivery_days_n, undated AS delivered_missing_delivery_date,
  {r6('score_sum', 'review_score_sum')}, score_n AS review_score_n, {big('items_sum', 'items_sold')}, items_n, {big('inst_sum', 'installments_sum')},
  inst_n AS installments_n, x_orders AS orders_no_primary_payment, x_owi AS owi_no_primary_payment, {money('x_gmv', 'gmv_no_primary_payment_brl')},
  {money('x_paid', 'payment_no_primary_payment_brl')} FROM @mm@""")
oracle("category_performance", f"""SELECT month AS purchase_month, label AS month_label, category AS product_category, lines AS order_lines, orders, people AS customers,
  products AS products_sold, sellers AS active_sellers, {money('gmv', 'gmv_brl')}, {money('goods', 'goods_brl')}, {money('freight', 'freight_brl')},
  {r6('line_value', 'avg_line_value_brl')}, {r6(share('freight', 'gmv'), 'freight_share_pct')},
  {r6(share('gmv', 'sum(gmv) OVER (PARTITION BY month)'), 'pct_of_month_gmv')}, x_category AS lines_missing_category,
  x_translation AS lines_missing_translation FROM @mc@""")
oracle("state_performance", f"""SELECT month AS purchase_month, label AS month_label, state AS customer_state, orders, people AS customers, {money('gmv', 'gmv_brl')},
  {money('freight', 'freight_brl')}, {r6('CAST(gmv AS DOUBLE) / nullif(owi, 0)', 'aov_brl')}, {r6(share('freight', 'gmv'), 'freight_share_pct')},
  {r6('CAST(days_sum AS DOUBLE) / nullif(days_n, 0)', 'avg_delivery_days')}, {r6(share('late', 'delivered'), 'late_delivery_rate_pct')},
  {r6('score_sum / nullif(score_n, 0)', 'avg_review_score')}, {r6(share('gmv', 'sum(gmv) OVER (PARTITION BY month)'), 'pct_of_month_gmv')},
  owi AS orders_with_items, delivered AS delivered_orders, late AS late_orders, {big('days_sum', 'delivery_days_sum')}, days_n AS delivery_days_n,
  {r6('score_sum', 'review_score_sum')}, score_n AS review_score_n FROM @ms@""")
oracle("payment_performance", f"""SELECT month AS purchase_month, label AS month_label, primary_type AS primary_payment_type, orders, {money('paid', 'payment_brl')},
  {money('gmv', 'gmv_brl')}, {r6('CAST(gmv AS DOUBLE) / nullif(owi, 0)', 'aov_brl')}, {r6('CAST(inst_sum AS DOUBLE) / nullif(inst_n, 0)', 'avg_installments')},
  split AS installment_orders, {r6(share('split', 'orders'), 'installment_rate_pct')},
  {r6(share('orders', 'sum(orders) OVER (PARTITION BY month)'), 'pct_of_month_orders')}, owi AS orders_with_items,
  {big('inst_sum', 'installments_sum')}, inst_n AS installments_n FROM @mp@""")
block("seg", """SELECT p.*, 6 - ntile(5) OVER (ORDER BY recency, person) AS r, ntile(5) OVER (ORDER BY paid NULLS FIRST, person) AS m FROM @ppl@ p""")
block("beh", """SELECT person, avg(mean_score) AS score, avg(CAST(freight AS DOUBLE)) AS freight, count(*) FILTER (is_late) AS late,
  count(*) FILTER (is_canceled) AS canceled, min(primary_type) AS sample_type FROM @fo@ GROUP BY person""")
block("segl", """SELECT *, CASE WHEN r >= 4 AND m >= 4 THEN 'Recent high-value' WHEN r >= 4 AND m <= 2 THEN 'Recent low-value'
  WHEN r <= 2 AND m >= 4 THEN 'Lapsed high-value' WHEN r <= 2 AND m <= 2 THEN 'Lapsed low-value' ELSE 'Mid' END AS segment FROM @seg@""")
oracle("customer_segments", f"""SELECT s.person AS customer_unique_id, state AS customer_state, city AS customer_city, n AS order_count, n > 1 AS is_repeat_customer,
  first_at AS first_purchased_at, last_at AS last_purchased_at, recency AS days_since_last_order, {money('paid', 'lifetime_payment_brl')},
  {r6('avg_paid', 'avg_order_payment_brl')}, {r6('b.score', 'avg_review_score')}, {r6('b.freight', 'avg_freight_brl')}, b.late AS late_orders,
  b.canceled AS canceled_orders, b.sample_type AS sample_payment_type, {big('r', 'r_score')}, {big('m', 'm_score')}, {big('r + m', 'rm_score')},
  segment AS rm_segment FROM @segl@ s LEFT JOIN @beh@ b ON b.person = s.person""")
oracle("segment_profile", f"""SELECT segment AS rm_segment, count(*) AS people, {r6('avg(CAST(paid AS DOUBLE))', 'avg_lifetime_brl')}, {r6('avg(recency)', 'avg_recency_days')}
  FROM @segl@ GROUP BY segment""")
oracle("segment_matrix", f"SELECT {big('r', 'r_score')}, {big('m', 'm_score')}, count(*) AS people FROM @seg@ GROUP BY r, m")
oracle("quintile_evenness", " UNION ALL ".join(
    f"SELECT '{c}_score' AS axis, count(*) AS buckets, max(n) - min(n) AS spread FROM (SELECT {c}, count(*) AS n FROM @seg@ GROUP BY {c})" for c in "rm"))
oracle("distributed_ntile", f"""SELECT {big('b', 'bucket')}, count(*) AS n, {r6('min(l_extendedprice)', 'lowest')}, {r6('max(l_extendedprice)', 'highest')} FROM
  (SELECT l_extendedprice, ntile(7) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) GROUP BY b""")
oracle("global_positions", f"""SELECT o_orderkey, {r6('o_totalprice', 'o_totalprice')}, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""")
block("per", "SELECT c.person, count(DISTINCT o.order_id) AS n FROM @o@ o JOIN @cust@ c ON c.customer_id = o.customer_id GROUP BY c.person")
oracle("frequency_distribution", """SELECT n AS orders_per_customer, count(*) AS customers, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_customers FROM @per@ GROUP BY n"""
       .replace("round(100.0 * count(*) / sum(count(*)) OVER (), 2)", "round(100.0 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 2)")
       .replace("SELECT n AS", "SELECT CAST(n AS BIGINT) AS"))
oracle("frequency_headline", """SELECT count(*) AS unique_customers, count(*) FILTER (n = 1) AS one_time_customers,
  round(100.0 * CAST(count(*) FILTER (n = 1) AS DOUBLE) / count(*), 2) AS pct_one_time, count(*) FILTER (n > 1) AS repeat_customers,
  max(n) AS max_orders_by_one_customer FROM @per@""")
oracle("status_profile", """SELECT order_status, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders), 2) AS pct FROM @o@ GROUP BY order_status""")
oracle("order_date_range", "SELECT CAST(min(purchased_at) AS DATE) AS first_order, CAST(max(purchased_at) AS DATE) AS last_order, count(*) AS orders FROM @o@")
oracle("money_gap", f"""SELECT CASE WHEN p.order_id IS NULL THEN 'items_only' WHEN i.order_id IS NULL THEN 'payment_only' ELSE 'both' END AS coverage,
  count(*) AS orders, {money('sum(i.total)', 'items_brl')}, {money('sum(p.paid)', 'payment_brl')}, {money('coalesce(sum(p.paid), 0) - coalesce(sum(i.total), 0)', 'gap_brl')}
  FROM @ia@ i FULL JOIN @pa@ p ON p.order_id = i.order_id GROUP BY 1""")
oracle("multi_category_orders", "SELECT n AS n_labels, count(*) AS orders FROM (SELECT order_id, count(DISTINCT category) AS n FROM @fl@ GROUP BY order_id) GROUP BY n")
oracle("payment_mix", f"SELECT payment_type, count(*) AS n_rows, {money('sum(paid)', 'paid_brl')} FROM @pay@ GROUP BY payment_type")
oracle("gap_flags", """SELECT in_window AS is_in_analysis_window, count(*) AS orders, count(*) FILTER (no_items) AS has_no_items, count(*) FILTER (no_payment) AS has_no_payment,
  count(*) FILTER (no_review) AS has_no_review, count(*) FILTER (f.zip NOT IN (SELECT zip FROM @pt@)) AS not_geocoded FROM @fo@ f GROUP BY in_window""")
oracle("monthly_share_by_region", f"""SELECT month AS purchase_month, region, {money('v', 'value_brl')}, {r6(share('v', 'sum(v) OVER (PARTITION BY month)'), 'pct_of_month')} FROM
  (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, r_name AS region, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS v
   FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)""")

# ---------------------------------------------------------------------------- data contracts
oracle("null_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) - count({c}) AS n_null FROM @fo@" for n, c in (
        ("order_id", "order_id"), ("customer_unique_id", "person"), ("delivered_at", "delivered_at"), ("items_total_brl", "total"),
        ("primary_payment_type", "primary_type"), ("avg_review_score", "mean_score"))))
oracle("duplicate_line_keys", f"SELECT order_id, {big('seq', 'order_item_seq')}, count(*) AS n_rows FROM @li@ GROUP BY order_id, seq HAVING count(*) > 1")


def probe(label: str, cols: str, source: str) -> str:
    return f"""SELECT '{label}' AS candidate_key, (SELECT count(*) FROM {source}) AS n_rows, count(*) AS distinct_keys,
      (SELECT count(*) FROM {source}) - count(*) AS excess_rows, (SELECT count(*) FROM {source}) = count(*) AS is_key FROM (SELECT DISTINCT {cols} FROM {source})"""


oracle("grain_probe_lines", " UNION ALL ".join([
    probe("order_id", "order_id", "@li@"), probe("order_id, order_item_seq", "order_id, seq", "@li@"),
    probe("order_id, order_item_seq, product_id, seller_id", "order_id, seq, product_id, seller_id", "@li@")]))
oracle("grain_probe_spine", probe("order_id", "order_id", "@o@") + " UNION ALL " + probe("customer_id", "customer_id", "@o@"))
oracle("unaccepted_statuses", "SELECT order_status AS value, count(*) AS n_rows FROM @o@ WHERE order_status NOT IN ('delivered', 'canceled') GROUP BY 1")
oracle("orphan_lookup_keys", """SELECT cat_pt AS orphan_key, count(*) AS n_rows FROM @prod@ p WHERE cat_pt IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM @lookup@ l WHERE l.cat_pt = p.cat_pt) GROUP BY cat_pt""")
oracle("missing_children", " UNION ALL ".join(
    f"""SELECT '{n}' AS child_table, (SELECT count(*) FROM @o@ WHERE order_id NOT IN (SELECT order_id FROM @{t}@)) AS parents_without_child,
    (SELECT count(*) FROM @{t}@ WHERE order_id NOT IN (SELECT order_id FROM @o@)) AS orphan_rows"""
    for n, t in (("order_items", "li"), ("order_payments", "pay"), ("order_reviews", "rev"))))
block("naive", """SELECT o.order_id, i.total, p.paid FROM @o@ o JOIN @li@ i ON i.order_id = o.order_id JOIN @pay@ p ON p.order_id = o.order_id JOIN @rev@ r ON r.order_id = o.order_id""")
oracle("fanout_report", " UNION ALL ".join(
    f"""SELECT (SELECT count(*) FROM orders) AS parent_rows, count(*) AS joined_rows, (SELECT count(*) FROM orders) - count(DISTINCT order_id) AS parent_keys_lost,
    '{n}' AS measure, 'ok' AS total_status, {money(f'(SELECT sum({c}) FROM @{t}@)', 'true_total')}, {money(f'sum({c})', 'joined_total')},
    {r6(f'CAST(sum({c}) AS DOUBLE) / CAST((SELECT sum({c}) FROM @{t}@) AS DOUBLE)', 'inflation')} FROM @naive@"""
    for n, c, t in (("items", "total", "li"), ("payments", "paid", "pay"))))

block("hot", """SELECT k, max(n) FILTER (t = 'o') AS n_o, max(n) FILTER (t = 'i') AS n_i, max(n) FILTER (t = 'p') AS n_p, max(v) FILTER (t = 'i') AS items, max(v) FILTER (t = 'p') AS payments FROM (
  SELECT 'o' AS t, CAST(order_id AS BIGINT) % 3 AS k, count(*) AS n, NULL AS v FROM @o@ GROUP BY 2 UNION ALL SELECT 'i', CAST(order_id AS BIGINT) % 3, count(*), sum(total) FROM @li@ GROUP BY 2
  UNION ALL SELECT 'p', CAST(order_id AS BIGINT) % 3, count(*), sum(paid) FROM @pay@ GROUP BY 2) GROUP BY k""")
oracle("fanout_hot_keys", " UNION ALL ".join(
    f"""SELECT CAST(sum(n_o) AS BIGINT) AS parent_rows, CAST(sum(CAST(n_o AS HUGEINT) * n_i * n_p) AS BIGINT) AS joined_rows, CAST(0 AS BIGINT) AS parent_keys_lost, '{m}' AS measure, 'ok' AS total_status,
    {money(f'sum({m})', 'true_total')}, {money(f'sum(CAST({m} AS DECIMAL(38,2)) * CAST(CAST(n_o AS HUGEINT) * {o} AS DECIMAL(20,0)))', 'joined_total')},
    {r6(f'CAST(sum(CAST({m} AS DECIMAL(38,2)) * CAST(CAST(n_o AS HUGEINT) * {o} AS DECIMAL(20,0))) AS DOUBLE) / CAST(sum({m}) AS DOUBLE)', 'inflation')} FROM @hot@"""
    for m, o in (("items", "n_p"), ("payments", "n_i"))))


def coverage(left: str, right: str, key: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {left}) AS left_rows, (SELECT count(DISTINCT {key}) FROM {left}) AS left_keys, (SELECT count(*) FROM {right}) AS right_rows,
      (SELECT count(DISTINCT {key}) FROM {right}) AS right_keys, (SELECT count(*) FROM {right} r WHERE EXISTS (SELECT 1 FROM {left} l WHERE l.{key} = r.{key})) AS matched_right_rows,
      (SELECT count(DISTINCT r.{key}) FROM {right} r JOIN {left} l ON l.{key} = r.{key}) AS matched_keys,
      {r6(share(f'(SELECT count(DISTINCT r.{key}) FROM {right} r JOIN {left} l ON l.{key} = r.{key})', f'(SELECT count(DISTINCT {key}) FROM {left})'), 'matched_pct')}"""


oracle("lead_deal_coverage", coverage("@lead@", "@deal@", "mql_id"))
oracle("seller_event_coverage", coverage("(SELECT c_custkey AS k FROM customer)", "(SELECT user_id AS k FROM events)", "k"))


def checks(rows: list[tuple[str, str, str, str]]) -> str:
    """(check, op, left expression, right expression) as rows of the comparison frame."""
    def holds(op: str) -> str:
        return "l IS NOT DISTINCT FROM r" if op == "=" else f"coalesce(l {op} r, false)"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, '{op}' AS op, l AS left_value, r AS right_value, {holds(op)} AS holds FROM (SELECT CAST({a} AS DECIMAL(38,2)) AS l, CAST({b} AS DECIMAL(38,2)) AS r)"
        for name, op, a, b in rows)


def total(expression: str, source: str, where: str = "") -> str:
    return f"(SELECT {expression} FROM @{source}@{' WHERE ' + where if where else ''})"


oracle("equal_rowcounts", checks([("equal row counts", "=", total("count(*)", "o"), total("count(*)", "fo"))]))
oracle("money_survives", checks([
    ("item_price_brl survives as items_price_brl", "=", total("sum(price)", "li"), total("sum(price)", "fo")),
    ("item_freight_brl survives as items_freight_brl", "=", total("sum(freight)", "li"), total("sum(freight)", "fo")),
    ("item_total_brl survives as items_total_brl", "=", total("sum(total)", "li"), total("sum(total)", "fo")),
    ("payment_value_brl survives as payment_total_brl", "=", total("sum(paid)", "pay"), total("sum(paid)", "fo"))]))
oracle("facts_agree", checks([
    ("same item money", "=", total("sum(total)", "fo"), total("sum(total)", "fl")),
    ("same orders with items", "=", total("count(*)", "fo", "NOT no_items"), total("count(DISTINCT order_id)", "fl"))]))
_IN = "in_window"
oracle("metric_layer_reconciles", checks([
    ("monthly has every month", "=", total("count(*)", "mm"), total("count(DISTINCT month)", "fo", _IN)),
    ("no month is skipped", "=", total("count(DISTINCT month)", "fo", _IN), total("date_diff('month', min(month), max(month)) + 1", "fo", _IN)),
    ("monthly orders", "=", total("sum(orders)", "mm"), total("count(*)", "fo", _IN)),
    ("monthly gmv", "=", total("sum(gmv)", "mm"), total("sum(total)", "fo", _IN)),
    ("monthly orders with items", "=", total("sum(owi)", "mm"), total("count(items)", "fo", _IN)),
    ("category gmv", "=", total("sum(gmv)", "mc"), total("sum(total)", "fo", _IN)),
    ("state gmv", "=", total("sum(gmv)", "ms"), total("sum(total)", "fo", _IN)),
    ("state orders", "=", total("sum(orders)", "ms"), total("count(*)", "fo", _IN)),
    ("payment gmv", "=", total("sum(gmv)", "mp"), total("coalesce(sum(total), 0)", "fo", _IN + " AND primary_type IS NOT NULL")),
    ("payment orders", "=", total("sum(orders)", "mp"), total("count(primary_type)", "fo", _IN)),
    ("category lines", "=", total("sum(lines)", "mc"), total("count(*)", "fl", _IN)),
    ("summed category orders, lower bound", ">=", total("sum(orders)", "mc"), total("count(items)", "fo", _IN)),
    ("summed category orders, upper bound", "<=", total("sum(orders)", "mc"), total("sum(lines)", "mc"))]))
_SHARED = {"orders_with_items": "owi", "delivered_orders": "delivered", "late_orders": "late", "delivery_days_n": "days_n",
           "delivery_days_sum": "days_sum", "review_score_n": "score_n"}
_PRIMARY = _IN + " AND primary_type IS NOT NULL"
oracle("additive_components_agree", checks(
    [(f"state {n}", "=", total(f"sum({c})", "ms"), total(f"sum({c})", "mm")) for n, c in _SHARED.items()] + [
        ("payment scope, every month", "=", """(SELECT count(*) FROM @mm@ a LEFT JOIN (SELECT month, sum(orders) AS o, sum(owi) AS w, sum(gmv) AS g, sum(paid) AS p FROM @mp@ GROUP BY month) b
          ON b.month = a.month WHERE coalesce(b.o, 0) + a.x_orders <> a.orders OR coalesce(b.w, 0) + a.x_owi <> a.owi
          OR coalesce(b.g, 0) + a.x_gmv <> coalesce(a.gmv, 0) OR coalesce(b.p, 0) + a.x_paid <> coalesce(a.paid, 0))""", "0"),
        ("reviewed orders have a score", "=", total("sum(score_n)", "mm"), total("sum(reviewed)", "mm")),
        ("orders with items have a count", "=", total("sum(items_n)", "mm"), total("sum(owi)", "mm")),
        ("timed deliveries are deliveries", "<=", total("sum(days_n)", "mm"), total("sum(delivered)", "mm")),
        ("late deliveries are deliveries", "<=", total("sum(late)", "mm"), total("sum(delivered)", "mm")),
        ("late implies delivered", "=", total("count(*)", "fo", "in_window AND is_late AND NOT is_delivered"), "0"),
        ("payment orders with items", "=", total("sum(owi)", "mp"), total("count(items)", "fo", _PRIMARY)),
        ("payment orders", "=", total("sum(orders)", "mp"), total("count(*)", "fo", _PRIMARY)),
        ("paid orders have installments", "=", total("sum(inst_n)", "mp"), total("sum(orders)", "mp")),
        ("low scores are reviews", "<=", total("sum(low)", "mm"), total("sum(reviewed)", "mm"))]))
oracle("recency_anchor", "SELECT min(recency) AS min_days FROM @ppl@")
oracle("row_rule_breaches", """SELECT label AS month_label, category AS product_category, 'one line per order' AS broken_rule FROM @mc@ WHERE orders <> lines
  UNION ALL SELECT label, category, 'goods and freight make GMV' FROM @mc@ WHERE goods + freight <> gmv""")
oracle("pinned_expectations", """SELECT strftime(month, '%Y-%m') AS month_label, CAST(NULL AS BIGINT) AS orders, n AS expected_orders, 'missing' AS problem FROM
  (SELECT date_trunc('month', purchased_at) AS month, count(*) AS n FROM @o@ GROUP BY 1) WHERE strftime(month, '%Y-%m') NOT IN (SELECT label FROM @mm@)""")
oracle("month_coverage", """SELECT count(DISTINCT date_trunc('month', purchased_at)) AS months,
  (year(max(purchased_at)) - year(min(purchased_at))) * 12 + month(max(purchased_at)) - month(min(purchased_at)) + 1 AS month_span FROM @o@""")
block("tot", """SELECT a.*, c.g AS c_gmv, c.k AS c_goods, c.f AS c_freight, c.o AS c_orders, c.l AS c_lines, s.o AS s_orders, s.g AS s_gmv, s.f AS s_freight, s.w AS s_owi,
  p.o AS p_orders, p.g AS p_gmv, p.p AS p_paid, p.w AS p_owi FROM @mm@ a
  LEFT JOIN (SELECT label, sum(gmv) AS g, sum(goods) AS k, sum(freight) AS f, sum(orders) AS o, sum(lines) AS l FROM @mc@ GROUP BY 1) c USING (label)
  LEFT JOIN (SELECT label, sum(orders) AS o, sum(gmv) AS g, sum(freight) AS f, sum(owi) AS w FROM @ms@ GROUP BY 1) s USING (label)
  LEFT JOIN (SELECT label, sum(orders) AS o, sum(gmv) AS g, sum(paid) AS p, sum(owi) AS w FROM @mp@ GROUP BY 1) p USING (label)""")
_EQUAL = [("category GMV", "c_gmv", "gmv"), ("category goods", "c_goods", "goods"), ("category freight", "c_freight", "freight"),
          ("state orders", "s_orders", "orders"), ("state GMV", "s_gmv", "gmv"), ("state freight", "s_freight", "freight"),
          ("state orders with items", "s_owi", "owi"), ("payment orders and excluded", "p_orders + x_orders", "orders"),
          ("payment GMV and excluded", "p_gmv + x_gmv", "gmv"), ("payment payments and excluded", "p_paid + x_paid", "paid"),
          ("payment orders with items and excluded", "p_owi + x_owi", "owi")]
oracle("extract_reconciliation", " UNION ALL ".join(
    [f"SELECT '{n}' AS check_name, label AS month_label, CASE WHEN {a} = {b} THEN 'pass' ELSE 'fail' END AS result FROM @tot@" for n, a, b in _EQUAL]
    + ["SELECT 'category orders', label, CASE WHEN c_orders BETWEEN owi AND c_lines THEN 'bounded' ELSE 'fail' END FROM @tot@"]))
# How many whole numbers of orders reproduce a printed order value: tried one by one.
block("fit", """SELECT label, state, any_value(owi) AS owi, any_value(printed) AS printed, count(*) FILTER (gmv IS NOT NULL AND abs(CAST(gmv AS DOUBLE) / n - printed) <= 0.00005 + 1e-9) AS candidates
  FROM (SELECT *, CAST(round(CAST(gmv AS DOUBLE) / owi, 4) AS DECIMAL(24,4)) AS printed, unnest(generate_series(1, orders)) AS n FROM @ms@) GROUP BY label, state""")
block("fitp", """SELECT label, primary_type, any_value(owi) AS owi, any_value(orders) AS orders,
  count(*) FILTER (gmv IS NOT NULL AND abs(CAST(gmv AS DOUBLE) / n - printed) <= 0.00005 + 1e-9) AS candidates
  FROM (SELECT *, CAST(round(CAST(gmv AS DOUBLE) / nullif(owi, 0), 4) AS DECIMAL(24,4)) AS printed, unnest(generate_series(1, orders)) AS n FROM @mp@) GROUP BY label, primary_type""")
block("fitm", f"""SELECT label, count(*) FILTER (abs(100.0 * k / reviewed - printed) <= 0.00005 + 1e-9) AS candidates FROM (
  SELECT *, CAST(round({share('low', 'reviewed')}, 4) AS DECIMAL(24,4)) AS printed, unnest(generate_series(0, reviewed)) AS k FROM @mm@) GROUP BY label""")
oracle("inference_status_counts", " UNION ALL ".join(
    f"""SELECT '{e}' AS extract, '{f}' AS field, CASE WHEN candidates = 1 THEN 'inferred' ELSE 'unavailable' END AS status, count(*) AS n FROM @{t}@ GROUP BY 3"""
    for e, f, t in (("monthly", "low_score_orders", "fitm"), ("state", "orders_with_items", "fit"), ("payment", "orders_with_items", "fitp"))))
block("known", """SELECT t.*, s.known AS s_known, s.unknown AS s_unknown, s.slack AS s_slack, p.known AS p_known, p.unknown AS p_unknown, p.slack AS p_slack FROM @tot@ t
  LEFT JOIN (SELECT label, coalesce(sum(f.owi) FILTER (candidates = 1), 0) AS known, count(*) FILTER (candidates <> 1) AS unknown,
    coalesce(sum(m.orders) FILTER (candidates <> 1), 0) AS slack FROM @fit@ f JOIN @ms@ m USING (label, state) GROUP BY label) s USING (label)
  LEFT JOIN (SELECT label, coalesce(sum(owi) FILTER (candidates = 1), 0) AS known, count(*) FILTER (candidates <> 1) AS unknown,
    coalesce(sum(orders) FILTER (candidates <> 1), 0) AS slack FROM @fitp@ GROUP BY label) p USING (label)""")


def older_checks() -> str:
    """(check name, result, where it applies) for files without additive components."""
    eq = lambda a, b: f"CASE WHEN {a} = {b} THEN 'pass' ELSE 'fail' END"
    within = lambda low, x, high: f"CASE WHEN {x} BETWEEN {low} AND {high} THEN 'bounded' ELSE 'fail' END"
    rows = [(n, eq(a, b), "true") for n, a, b in _EQUAL[:6]] + [
        ("category orders", within("owi", "c_orders", "c_lines"), "true"),
        ("state orders with items", eq("s_known", "owi"), "s_unknown = 0"),
        ("state orders with items, bounds", within("s_known", "owi", "s_known + s_slack"), "s_unknown > 0"),
        ("payment orders", "'fail'", "p_orders > orders"),
        ("payment GMV", eq("p_gmv", "gmv"), "p_orders = orders"), ("payment payments", eq("p_paid", "paid"), "p_orders = orders"),
        ("payment orders with items", eq("p_known", "owi"), "p_orders = orders AND p_unknown = 0"),
        ("payment orders with items, bounds", within("p_known", "owi", "p_known + p_slack"), "p_orders = orders AND p_unknown > 0"),
        ("payment GMV, part of month", within("0", "p_gmv", "gmv"), "p_orders < orders"),
        ("payment orders with items, excluded unknown", "'unsupported'", "p_orders < orders")]
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, {result} AS result FROM @known@ WHERE {where}" for n, result, where in rows)


oracle("extract_reconciliation_without_components", f"SELECT check_name, result, count(*) AS n FROM ({older_checks()}) GROUP BY check_name, result")
oracle("extract_violations", "SELECT '' AS extract, '' AS row_key, '' AS problem WHERE false")
oracle("extract_violations_damaged", " UNION ALL ".join([
    "SELECT 'monthly' AS extract, '' AS row_key, 'months are not contiguous' AS problem",
    *[f"SELECT '{n}' AS extract, '{GAP}' AS row_key, 'month outside the monthly extract' AS problem" for n in ("category", "state", "payment")],
    "SELECT 'state', '2031-01', 'month outside the monthly extract'",
    f"SELECT 'payment', concat_ws('/', label, primary_type), 'date is no first of a month' FROM @mp@ WHERE label = '{LAST}'",
    f"SELECT 'category', concat_ws('/', label, category), 'duplicate key' FROM @mc@ WHERE label = '{LAST}'",
    f"SELECT 'category', concat_ws('/', label, category), 'orders between 1 and lines' FROM @mc@ WHERE label = '{FIRST}'"]))
oracle("inferred_denominators", """SELECT label AS month_label, state AS customer_state, CASE WHEN candidates = 1 THEN owi END AS value,
  CASE WHEN candidates = 1 THEN 'inferred' ELSE 'unavailable' END AS status, candidates,
  CASE WHEN printed IS NULL THEN 'no ratio printed' WHEN candidates = 0 THEN 'nothing fits' WHEN candidates = 1 THEN 'one fits' ELSE 'more than one fits' END AS reason FROM @fit@""")
oracle("inferred_numerators", f"""SELECT label AS month_label, CASE WHEN candidates = 1 THEN low END AS value,
  CASE WHEN candidates = 1 THEN 'inferred' ELSE 'unavailable' END AS status, candidates,
  CASE WHEN printed IS NULL THEN 'no rate printed' WHEN candidates = 0 THEN 'nothing fits' WHEN candidates = 1 THEN 'one fits' ELSE 'more than one fits' END AS reason FROM (
  SELECT label, any_value(low) AS low, any_value(printed) AS printed, count(*) FILTER (abs(100.0 * k / reviewed - printed) <= 0.05 + 1e-9) AS candidates FROM (
    SELECT *, CAST(round({share('low', 'reviewed')}, 1) AS DECIMAL(24,1)) AS printed, unnest(generate_series(0, reviewed)) AS k FROM @mm@) GROUP BY label)""")
oracle("typed_parse_of_text", f"""SELECT count(v) AS money, {big('sum(round(v * 100))', 'cents')}, count(v) FILTER (v = floor(v)) AS counts,
  {big('sum(v) FILTER (v = floor(v))', 'count_sum')}, count(v) AS numbers, count(*) - count(v) AS not_numbers FROM (
  SELECT l_extendedprice AS v FROM lineitem UNION ALL SELECT l_quantity FROM lineitem UNION ALL SELECT l_discount FROM lineitem UNION ALL SELECT l_tax FROM lineitem
  UNION ALL SELECT CAST(NULL AS DOUBLE) FROM lineitem UNION ALL SELECT CAST(NULL AS DOUBLE) FROM lineitem)""")

# ---------------------------------------------------------------------------- selection roll-ups
_SEL = f"label BETWEEN '{FIRST}' AND '{LAST}'"


def cents(expression: str) -> str:
    return f"CAST({expression} * 100 AS BIGINT)"


def sum_cells(name: str, expression: str) -> str:
    return f"'ok' AS {name}_status, CAST(sum({expression}) AS BIGINT) AS {name}_value, count(*) - count({expression}) AS {name}_nulls, CAST(NULL AS VARCHAR) AS {name}_reason"


def rate_cells(name: str, num: str, den: str) -> str:
    return f"""'ok' AS {name}_status, {r6(f'100.0 * {num} / {den}', f'{name}_value')}, {r6(num, f'{name}_num')}, {r6(den, f'{name}_den')}, CAST(NULL AS VARCHAR) AS {name}_reason"""


def mean_cells(name: str, total_: str, n: str) -> str:
    return f"""'ok' AS {name}_status, {r6(f'CAST({total_} AS DOUBLE) / {n}', f'{name}_value')}, {r6(total_, f'{name}_num')}, {r6(n, f'{name}_den')}, CAST(NULL AS VARCHAR) AS {name}_reason"""


def aov_cells(gmv: str, n: str) -> str:
    return f"""'ok' AS aov_status, {r6(f'floor({gmv} / CAST({n} AS DOUBLE) + 0.5)', 'aov_value')}, {r6(gmv, 'aov_num')}, {r6(n, 'aov_den')}, CAST(NULL AS VARCHAR) AS aov_reason"""


def one_cell(name: str, expression: str) -> str:
    return f"""CASE WHEN count(*) = 1 THEN 'ok' ELSE 'unavailable' END AS {name}_status, CASE WHEN count(*) = 1 THEN {big(f'sum({expression})', 'x')[:-5]} END AS {name}_value,
      CASE WHEN count(*) <> 1 THEN CAST(sum({expression}) AS BIGINT) END AS {name}_added,
      CASE WHEN count(*) <> 1 THEN 'a distinct count of one cell; not a sum over cells' END AS {name}_reason"""


_GMV, _FR = "sum(CAST(gmv * 100 AS BIGINT))", "sum(CAST(freight * 100 AS BIGINT))"
_OVERVIEW = f"""SELECT {sum_cells('orders', 'orders')}, {sum_cells('orders_with_items', 'owi')}, {sum_cells('gmv', cents('gmv'))}, {sum_cells('goods', cents('goods'))},
  {sum_cells('freight', cents('freight'))}, {sum_cells('payments', cents('paid'))}, {sum_cells('canceled', 'canceled')}, {sum_cells('delivered', 'delivered')},
  {sum_cells('late', 'late')}, {sum_cells('reviewed', 'reviewed')}, {sum_cells('low', 'low')},
  {r6('avg(CASE WHEN delivered > 0 THEN 100.0 * late / delivered END)', 'naive_late_mean')}, count(*) AS months,
  {mean_cells('delivery_days', 'sum(days_sum)', 'sum(days_n)')}, {mean_cells('review_score', 'sum(score_sum)', 'sum(score_n)')},
  {mean_cells('items_per_order', 'sum(items_sum)', 'sum(items_n)')}, {mean_cells('installments', 'sum(inst_sum)', 'sum(inst_n)')},
  {one_cell('active_customers', 'people')}, {aov_cells(_GMV, 'sum(owi)')}, {rate_cells('cancel_rate', 'sum(canceled)', 'sum(orders)')},
  {rate_cells('late_rate', 'sum(late)', 'sum(delivered)')}, {rate_cells('low_rate', 'sum(low)', 'sum(reviewed)')}, {rate_cells('freight_share', _FR, _GMV)}
  FROM @mm@ WHERE """
oracle("overview", _OVERVIEW + _SEL)
oracle("overview_single_month", _OVERVIEW + f"label = '{FIRST}'")
oracle("overview_series", f"""SELECT label AS month_label, orders, {big('gmv * 100', 'gmv_c')}, {r6(share('late', 'delivered'), 'late_rate')}, {r6(share('low', 'reviewed'), 'low_rate')},
  'observed' AS low_status, {r6(share('canceled', 'orders'), 'cancel_rate')}, {big('floor(CAST(gmv AS DOUBLE) * 100 / owi + 0.5)', 'aov_c')},
  {r6('CAST(days_sum AS DOUBLE) / nullif(days_n, 0)', 'avg_delivery_days')}, {r6('score_sum / nullif(score_n, 0)', 'avg_review_score')}, people AS active_customers
  FROM @mm@ WHERE {_SEL}""")
_ALL_GMV = f"(SELECT {_GMV} FROM @mc@ WHERE {_SEL})"
oracle("category_view", f"""SELECT category AS product_category, count(*) AS cells, {big('sum(lines)', 'order_lines')}, {big('sum(CAST(goods * 100 AS BIGINT))', 'goods_c')},
  {big('sum(orders)', 'orders')}, {big('sum(x_category)', 'lines_missing_category')}, {big('sum(x_translation)', 'lines_missing_translation')},
  {sum_cells('gmv', cents('gmv'))}, {sum_cells('freight', cents('freight'))}, {one_cell('customers', 'people')}, {one_cell('sellers', 'sellers')},
  {rate_cells('freight_share', _FR, _GMV)}, {big(f'floor({_GMV} / CAST(sum(lines) AS DOUBLE) + 0.5)', 'avg_line_c')}, {rate_cells('share_of_selected_gmv', _GMV, _ALL_GMV)}
  FROM @mc@ WHERE {_SEL} GROUP BY category""")
oracle("category_view_search", f"""SELECT category AS product_category, {big('sum(lines)', 'order_lines')}, {big(_GMV, 'gmv_value')}, {r6(f'100.0 * {_FR} / {_GMV}', 'freight_share_value')},
  {r6(f'100.0 * {_GMV} / {_ALL_GMV}', 'share_of_selected_gmv_value')} FROM @mc@ WHERE {_SEL} AND lower(category) LIKE '%large%' GROUP BY category
  ORDER BY 100.0 * {_FR} / {_GMV} DESC, category LIMIT 5""")
oracle("category_totals", f"""SELECT {sum_cells('total_gmv', cents('gmv'))}, {big('sum(lines)', 'total_lines')}, {big('sum(orders)', 'category_order_pairs')},
  {big('sum(x_category)', 'lines_missing_category')}, {big('sum(x_translation)', 'lines_missing_translation')}, count(DISTINCT category) AS all_count,
  count(DISTINCT category) FILTER (lower(category) LIKE '%large%') AS matched_count, false AS no_match FROM @mc@ WHERE {_SEL}""")
_STATE = f"""grouping(state) = 1 AS is_total, count(*) AS cells, {big('sum(orders)', 'orders')}, {sum_cells('gmv', cents('gmv'))}, {sum_cells('freight', cents('freight'))},
  {sum_cells('orders_with_items', 'owi')}, {mean_cells('delivery_days', 'sum(days_sum)', 'sum(days_n)')}, {one_cell('customers', 'people')},
  {aov_cells(_GMV, 'sum(owi)')}, {rate_cells('freight_share', _FR, _GMV)}, {rate_cells('late_rate', 'sum(late)', 'sum(delivered)')}"""
oracle("state_view", f"SELECT state AS customer_state, {_STATE} FROM @ms@ WHERE {_SEL} GROUP BY ROLLUP (state)")
oracle("state_view_chosen", f"SELECT state AS customer_state, {_STATE} FROM @ms@ WHERE {_SEL} AND state IN ('N01', 'N02', 'N03') GROUP BY ROLLUP (state)")
oracle("payment_view", f"""SELECT primary_type AS primary_payment_type, count(*) AS cells, {sum_cells('orders', 'orders')}, {big('sum(CAST(paid * 100 AS BIGINT))', 'payment_c')},
  {sum_cells('gmv', cents('gmv'))}, {sum_cells('installment_orders', 'split')}, {sum_cells('orders_with_items', 'owi')},
  {mean_cells('installments', 'sum(inst_sum)', 'sum(inst_n)')}, {rate_cells('share_of_orders', 'sum(orders)', f'(SELECT sum(orders) FROM @mp@ WHERE {_SEL})')},
  {aov_cells(_GMV, 'sum(owi)')}, {rate_cells('installment_rate', 'sum(split)', 'sum(orders)')} FROM @mp@ WHERE {_SEL} AND primary_type IN ('boleto', 'voucher') GROUP BY primary_type""")
oracle("decision_totals", f"""SELECT min(label) AS first_month, max(label) AS last_month, {big('sum(orders)', 'orders')}, {big('sum(owi)', 'orders_with_items')}, {big(_GMV, 'gmv_c')},
  {big(_FR, 'freight_c')}, {big('sum(late)', 'late_orders')}, {big('sum(delivered)', 'delivered_orders')}, {big('sum(low)', 'low_score_orders')},
  {big('sum(reviewed)', 'reviewed_orders')}, {big('sum(canceled)', 'canceled_orders')}, {r6('avg(100.0 * late / nullif(delivered, 0))', 'naive_late_pct')},
  {big(f'floor({_GMV} / CAST(sum(owi) AS DOUBLE) + 0.5)', 'aov_c')}, {r6(share('sum(late)', 'sum(delivered)'), 'late_pct')},
  {r6(share('sum(low)', 'sum(reviewed)'), 'low_score_pct')}, {r6(share('sum(canceled)', 'sum(orders)'), 'cancel_pct')}, {r6(share(_FR, _GMV), 'freight_pct')} FROM @mm@""")
oracle("worst_months", f"""SELECT label AS month_label, late AS late_orders, delivered AS delivered_orders, {r6(share('late', 'delivered'), 'late_pct')} FROM @mm@ WHERE delivered > 0
  ORDER BY {share('late', 'delivered')} DESC, label DESC LIMIT 3""")
block("fx", f"SELECT state, sum(orders) AS orders, {share('sum(freight)', 'sum(gmv)')} AS share FROM @ms@ GROUP BY state HAVING sum(gmv) IS NOT NULL")
oracle("freight_extremes", f"""SELECT a.state AS lowest_customer_state, {r6('a.share', 'lowest_share')}, {big('a.orders', 'lowest_orders')}, b.state AS highest_customer_state,
  {r6('b.share', 'highest_share')}, {big('b.orders', 'highest_orders')} FROM (SELECT * FROM @fx@ ORDER BY share, state LIMIT 1) a,
  (SELECT * FROM @fx@ ORDER BY share DESC, state DESC LIMIT 1) b""")

# ---------------------------------------------------------------------------- leads
oracle("lead_features_table", f"""SELECT mql_id, won AS is_won, ever AS is_won_ever, lag AS days_to_win, won_date, contact + {HORIZON + 1} AS label_mature_on,
  contact >= DATE '{SCOPE_FROM}' AS is_in_model_window, contact AS first_contact_date, channel AS lead_origin_channel, page AS landing_page_id,
  page_n AS page_lead_volume, prior_n AS page_lead_volume_prior, month(contact) AS contact_month, year(contact) AS contact_year, dayofweek(contact) AS contact_dow,
  dayofweek(contact) IN (0, 6) AS is_weekend_contact, date_diff('day', (SELECT min(contact) FROM @lead@), contact) AS days_since_campaign_start FROM @lf@""")
oracle("lead_contract", f"""SELECT mql_id, won AS is_won, lag AS days_to_win, contact + {HORIZON + 1} AS label_mature_on, page_n AS page_lead_volume, prior_n AS page_lead_volume_prior
  FROM @lf@ WHERE won <> coalesce(lag BETWEEN 0 AND {HORIZON}, false) OR prior_n > page_n - 1""")
oracle("lead_contract_damaged", f"""SELECT mql_id, CASE WHEN mql_id % 97 = 0 THEN NOT won ELSE won END AS is_won, lag AS days_to_win,
  contact + {HORIZON + 1} + CASE WHEN mql_id % 97 = 1 THEN 1 ELSE 0 END AS label_mature_on, page_n AS page_lead_volume, CASE WHEN mql_id % 97 = 2 THEN page_n ELSE prior_n END AS page_lead_volume_prior
  FROM @lf@ WHERE mql_id % 97 < 2 OR mql_id % 97 = 2 AND page_n IS NOT NULL""")
oracle("prior_counts_agree", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM @lead@")
_CONV = f"count(*) AS leads, count(*) FILTER (won) AS won, {r6(share('count(*) FILTER (won)', 'count(*)'), 'conversion_pct')}"
oracle("conversion_by_cohort", f"SELECT CAST(date_trunc('month', contact) AS DATE) AS cohort_month, {_CONV} FROM @lf@ GROUP BY 1")
oracle("conversion_by_channel", f"SELECT channel AS lead_origin_channel, {_CONV} FROM @lf@ GROUP BY 1")
oracle("win_lag_distribution", f"""SELECT count(lag) AS wins, min(lag) AS min_days, {r6('quantile_cont(lag, 0.5)', 'median_days')}, {r6('avg(lag)', 'mean_days')},
  {r6('quantile_cont(lag, 0.75)', 'p75_days')}, {r6('quantile_cont(lag, 0.9)', 'p90_days')}, max(lag) AS max_days FROM @lf@""")
oracle("landing_page_cardinality", """SELECT count(*) AS distinct_keys, count(*) FILTER (n = 1) AS single_row_keys, max(n) AS largest_group
  FROM (SELECT page, count(*) AS n FROM @lead@ WHERE page IS NOT NULL GROUP BY page)""")
_H = DESIGN.window


def cohort(first: str, last: str, known: str) -> str:
    return f"""SELECT *, CASE WHEN lag BETWEEN 0 AND {_H} AND won_date < DATE '{known}' THEN 1 ELSE 0 END AS label FROM @lf@
      WHERE contact BETWEEN DATE '{first}' AND DATE '{last}'"""


block("tr", cohort(DESIGN.learn_from.isoformat(), "2024-01-12", DESIGN.cut.isoformat()))
block("te", cohort(DESIGN.judge.first.isoformat(), DESIGN.judge.last.isoformat(), "2024-01-31"))
oracle("cohort_labels", " UNION ALL ".join(
    f"""SELECT '{n}' AS cohort, count(*) AS leads, {big('sum(label)', 'positives')}, count(*) FILTER (contact + {_H + 1} > DATE '{DESIGN.cut}') AS immature FROM @{t}@"""
    for n, t in (("train", "tr"), ("score", "te"))))
oracle("split_audit", f"""SELECT count(*) AS train_leads, min(contact) + 7 AS first_window_end, max(contact) + 7 AS last_window_end, min(contact) + 8 AS first_usable_on,
  max(contact) + 8 AS last_usable_on, {r6("CAST(count(*) FILTER (contact + 8 <= DATE '2024-01-16') AS DOUBLE) / count(*)", 'share_usable_at_cut')},
  DATE '2024-01-08' AS latest_contact_usable FROM @lead@ WHERE contact BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'""")
_LOGV, _DOW, _WKD = "ln(1 + prior_n)", "CAST(isodow(contact) - 1 AS DOUBLE)", "CASE WHEN isodow(contact) >= 6 THEN 1.0 ELSE 0.0 END"
oracle("design_matrix", f"SELECT mql_id, channel, {r6(_LOGV, 'log_page_volume')}, {r6(_DOW, 'contact_weekday')}, {r6(_WKD, 'is_weekend')} FROM @lf@")
oracle("channel_baselines", f"""SELECT mql_id, CAST(label AS BIGINT) AS label, {r6('(SELECT avg(label) FROM @tr@)', 'score_base')},
  {r6('coalesce(c.rate, (SELECT avg(label) FROM @tr@))', 'score_channel')}
  FROM @te@ t LEFT JOIN (SELECT channel, avg(label) AS rate FROM @tr@ GROUP BY channel) c ON c.channel = t.channel""")
oracle("encoder_moments", "SELECT " + ", ".join(
    f"{r6(f'avg({x})', f'mean_{n}')}, {r6(f'stddev_pop({x})', f'spread_{n}')}" for n, x in (("log_page_volume", _LOGV), ("contact_weekday", _DOW), ("is_weekend", _WKD))) + " FROM @tr@")

oracle("lead_model_evidence", "SELECT count(*) AS training_rows, true AS mean_is_base_rate, true AS trees_beat_constant, true AS trees_near_channels, true AS constant_has_no_skill FROM @tr@")
block("lv", "SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS level, count(*) OVER () AS n FROM (SELECT DISTINCT channel FROM @tr@)")
oracle("encoded_leads", f"""SELECT mql_id, t.channel, CASE WHEN level = 0 THEN repeat('0', CAST(n - 1 AS BIGINT))
  ELSE repeat('0', CAST(level - 1 AS BIGINT)) || '1' || repeat('0', CAST(n - 1 - level AS BIGINT)) END AS indicators, n - 1 + 3 AS width,
  {r6(f'({_LOGV} - (SELECT avg({_LOGV}) FROM @tr@)) / (SELECT stddev_pop({_LOGV}) FROM @tr@)', 'first_number')} FROM @tr@ t JOIN @lv@ l ON l.channel = t.channel""")
_J = DESIGN.judge
oracle("design_problems", " UNION ALL ".join(
    f"""SELECT '{name}' AS design, CAST({n} AS BIGINT) AS n_problems, '2024-01-01..{last}' AS learned_from, DATE '2024-01-12' AS settled, '{a}..{b}' AS judged_on,
    (SELECT count(*) FROM @lead@ WHERE contact BETWEEN DATE '{a}' AND DATE '{b}') AS leads"""
    for name, n, last, a, b in (
        ("sound", 0, "2024-01-12", _J.first, _J.last), ("labels not settled", 0, "2024-01-19", _J.first, _J.last), ("judged before the cut", 1, "2024-01-12", "2024-01-15", "2024-01-23"),
        ("outcomes not seen", 1, "2024-01-12", _J.first, _J.last), ("unknown features", 1, "2024-01-12", _J.first, _J.last), ("nobody to judge", 1, "2024-01-12", "2024-01-23", "2024-01-21"))))
oracle("month_gaps", f"""SELECT * FROM (SELECT month AS after_month, lag(month) OVER (ORDER BY month) AS before_month
  FROM (SELECT DISTINCT CAST(date_trunc('month', purchased_at) AS DATE) AS month FROM @o@ WHERE strftime(purchased_at, '%Y-%m') NOT IN ('1996-03', '{GAP}', '1998-07')))
  WHERE date_diff('month', before_month, after_month) > 1""")
oracle("lead_model_is_optimal", "SELECT count(*) AS training_rows, true AS gradient_is_zero FROM @tr@")


def rated(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS model, count(*) AS n, {big('sum(label)', 'positives')}, {r6('avg(label)', 'prevalence')}, {r6('avg(score)', 'mean_score')},
      {r6('avg((score - label) * (score - label))', 'brier')}, {r6("(sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)))", 'auc')}
      FROM (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM (
        SELECT label, {score} AS score FROM @te@ t LEFT JOIN (SELECT channel, avg(label) AS rate FROM @tr@ GROUP BY channel) c ON c.channel = t.channel))"""


oracle("lead_baseline_metrics", rated("score_base", "(SELECT avg(label) FROM @tr@)") + " UNION ALL " + rated("score_channel", "coalesce(c.rate, (SELECT avg(label) FROM @tr@))"))

# ---------------------------------------------------------------------------- score rankings
oracle("score_steps", f"""SELECT {r6('score', 'score')}, count(*) AS n, {big('sum(label)', 'pos')}, {big('sum(count(*)) OVER w', 'n_upto')}, {big('sum(sum(label)) OVER w', 'pos_upto')}
  FROM @sc@ GROUP BY sc.score WINDOW w AS (ORDER BY sc.score DESC)""")


def quality(source: str, with_k: bool) -> str:
    """AUC from mean ranks; average precision from the running share of positives."""
    return f"""WITH_BLOCKS, ranked AS (SELECT id, label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid,
      count(*) OVER (ORDER BY score DESC) AS upto, sum(label) OVER (ORDER BY score DESC) AS hits, row_number() OVER (ORDER BY score DESC, id) AS place FROM @{source}@),
    size AS (SELECT count(*) AS n, sum(label) AS p, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS k FROM ranked),
    cut AS (SELECT score AS s FROM ranked, size WHERE place = k),
    tie AS (SELECT count(*) FILTER (score > s) AS above, coalesce(sum(label) FILTER (score > s), 0) AS above_p, count(*) FILTER (score = s) AS b, sum(label) FILTER (score = s) AS bp FROM ranked, cut)
    SELECT n, {big('p', 'positives')}, {r6('CAST(p AS DOUBLE) / n', 'prevalence')}, {r6('(SELECT avg(score) FROM ranked)', 'mean_score')},
      {r6('(SELECT avg((score - label) * (score - label)) FROM ranked)', 'brier')}, (SELECT count(DISTINCT score) FROM ranked) AS distinct_scores,
      {r6('((SELECT sum(mid) FROM ranked WHERE label = 1) - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p))', 'auc')},
      {r6('(SELECT sum(CAST(hits AS DOUBLE) / upto) FROM ranked WHERE label = 1) / p', 'pr_auc')},
      {'k AS top_k,' if with_k else ''} {big('(SELECT sum(label) FROM ranked, size z WHERE place <= z.k)', 'top_deterministic_hits')},
      {r6('above_p + CAST(bp AS DOUBLE) * (k - above) / b', 'top_expected_hits')}, {big('above_p + greatest(0, k - above - (b - bp))', 'top_min_hits')},
      {big('above_p + least(bp, k - above)', 'top_max_hits')}, b AS top_tie_block, {big('bp', 'top_tie_block_positives')}, above AS top_strictly_above,
      {r6('CAST(p AS DOUBLE) / n * k', 'random_expected_hits')} FROM size, tie"""


def with_blocks(body: str, source: str) -> str:
    return build(f"SELECT * FROM @{source}@").split(f" SELECT * FROM {source}")[0] + body.replace("WITH_BLOCKS", "").replace(f"@{source}@", source)


SQL["ranking_quality"] = with_blocks(quality("sc", False), "sc")
SQL["ranking_quality_documents"] = with_blocks(quality("scd", True), "scd")


def compared(population: str, source: str) -> str:
    """One population's scores as they are, reversed and all equal, through the same measures."""
    versions = {"score": "score", "reversed": "1 - score", "flat": "0.5"}
    parts = []
    for model, score in versions.items():
        text = quality("v", True).replace("WITH_BLOCKS,", "WITH").replace("@v@", f"(SELECT id, label, CAST({score} AS DOUBLE) AS score FROM @{source}@)")
        parts.append(f"SELECT '{population}' AS population, '{model}' AS model, * FROM ({text})")
    return " UNION ALL ".join(parts)


oracle("model_comparison", compared("orders", "sc") + " UNION ALL " + compared("documents", "scd"))

block("flat", "SELECT id, label, 0.5 AS score FROM @sc@")


def top_sql(source: str, k: int) -> str:
    return f"""SELECT CAST({k} AS BIGINT) AS k, (SELECT count(*) FROM @{source}@) AS n,
      {big(f'(SELECT sum(label) FROM (SELECT label FROM @{source}@ ORDER BY score DESC, id LIMIT {k}))', 'deterministic_hits')},
      {r6(f'above_p + CAST(bp AS DOUBLE) * ({k} - above) / b', 'expected_hits')}, {big(f'above_p + greatest(0, {k} - above - (b - bp))', 'min_hits')},
      {big(f'above_p + least(bp, {k} - above)', 'max_hits')}, b AS tie_block, {big('bp', 'tie_block_positives')}, above AS strictly_above
      FROM (SELECT count(*) FILTER (score > s) AS above, coalesce(sum(label) FILTER (score > s), 0) AS above_p, count(*) FILTER (score = s) AS b,
        sum(label) FILTER (score = s) AS bp FROM @{source}@, (SELECT min(score) AS s FROM (SELECT score FROM @{source}@ ORDER BY score DESC LIMIT {k})))"""


oracle("top_hundred", top_sql("sc", 100))
oracle("constant_score_top", top_sql("flat", 500))
oracle("cumulative_gains", f"""SELECT {big('step', 'step')}, {big('k', 'k')}, {r6('expected', 'expected_hits')}, {r6('expected / (SELECT sum(label) FROM @sc@)', 'captured')}, {r6('step / 10.0', 'share')} FROM (
  SELECT 0 AS step, 0 AS k, 0.0 AS expected UNION ALL
  SELECT step, k, sum(label * CASE WHEN score > s THEN 1.0 WHEN score = s THEN CAST(k - above AS DOUBLE) / b ELSE 0.0 END) AS expected FROM @sc@ sc, (
    SELECT step, k, s, (SELECT count(*) FROM @sc@ z WHERE z.score > s) AS above, (SELECT count(*) FROM @sc@ z WHERE z.score = s) AS b FROM (
      SELECT step, k, (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC, id) AS place FROM @sc@) q WHERE q.place = k) AS s FROM (
        SELECT step, CAST(floor((SELECT count(*) FROM @sc@) * step / 10.0) AS BIGINT) AS k FROM (SELECT unnest(generate_series(1, 10)) AS step)))) GROUP BY step, k)""")
oracle("decile_lift", f"""SELECT k, {r6('top_rate', 'top_rate')}, {r6('base_rate', 'base_rate')}, {r6('top_rate / base_rate', 'lift')} FROM (
  SELECT k, (above_p + CAST(bp AS DOUBLE) * (k - above) / b) / k AS top_rate, base_rate FROM (
    SELECT count(*) FILTER (score > s) AS above, sum(label) FILTER (score > s) AS above_p, count(*) FILTER (score = s) AS b, sum(label) FILTER (score = s) AS bp, avg(label) AS base_rate, any_value(k) AS k
    FROM @sc@ sc, (SELECT min(score) AS s, count(*) AS k FROM (SELECT score FROM @sc@ ORDER BY score DESC LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM @sc@)))))""")

# ---------------------------------------------------------------------------- randomised experiment
Z95, Z80P, Z95P = (NormalDist().inv_cdf(p) for p in (0.975, 0.8, 0.95))
block("ac", """SELECT segment, count(*) FILTER (treatment = 1) AS n_t, count(*) FILTER (treatment = 1 AND conversion = 1) AS y_t, count(*) FILTER (treatment = 0) AS n_c,
  count(*) FILTER (treatment = 0 AND conversion = 1) AS y_c, count(*) FILTER (exposure = 1) AS n_exposed, count(*) FILTER (exposure = 1 AND conversion = 1) AS y_exposed
  FROM @rct@ GROUP BY segment""")
block("aa", "SELECT sum(n_t) AS n_t, sum(y_t) AS y_t, sum(n_c) AS n_c, sum(y_c) AS y_c, sum(n_exposed) AS n_exposed, sum(y_exposed) AS y_exposed FROM @ac@")


def stats(source: str) -> str:
    return f"""SELECT *, p_t - p_c AS d, sqrt(p_t * (1 - p_t) / n_t + p_c * (1 - p_c) / n_c) AS se,
      sqrt((1 - p_t) / y_t + (1 - p_c) / y_c) AS se_log, (p_t - p_c) / pi AS cace,
      sqrt((p_t * (1 - p_t) / n_t + p_c * (1 - p_c) / n_c) / (pi * pi) + (p_t - p_c) * (p_t - p_c) * pi * (1 - pi) / n_t / (pi * pi * pi * pi)
        - 2 * (p_t - p_c) * ((y_exposed / n_t - p_t * pi) / n_t) / (pi * pi * pi)) AS cace_se,
      (p_c - (1 - pi) * never) / pi AS complier, sqrt(1 / n_t + 1 / n_c) AS root,
      (p_t - p_c) / sqrt((y_t + y_c) / (n_t + n_c) * (1 - (y_t + y_c) / (n_t + n_c)) * (1 / n_t + 1 / n_c)) AS z
      FROM (SELECT *, y_t / n_t AS p_t, y_c / n_c AS p_c, n_exposed / n_t AS pi, y_exposed / n_exposed AS px, (y_t - y_exposed) / (n_t - n_exposed) AS never
        FROM (SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('n_t', 'y_t', 'n_c', 'y_c', 'n_exposed', 'y_exposed'))}) FROM {source}))"""


block("st", stats("@ac@"))
block("sa", stats("@aa@"))
_SIX = ", ".join(big(c, c) for c in ("n_t", "y_t", "n_c", "y_c", "n_exposed", "y_exposed"))
oracle("documented_counts", f"SELECT {_SIX} FROM @aa@")
oracle("arm_counts", f"SELECT segment, {_SIX} FROM @ac@")


def cohen(zp: float) -> str:
    return f"pow(sin(least({math.pi / 2}, asin(sqrt(p_c)) + {Z95 + zp} * root / 2)), 2) - p_c"


_READ = ", ".join(r6(e, n) for n, e in {
    "p_t": "p_t", "p_c": "p_c", "itt": "d", "itt_se": "se", "itt_low": f"d - {Z95} * se", "itt_high": f"d + {Z95} * se",
    "relative_lift": "p_t / p_c - 1", "relative_low": f"exp(ln(p_t / p_c) - {Z95} * se_log) - 1", "relative_high": f"exp(ln(p_t / p_c) + {Z95} * se_log) - 1",
    "compliance": "pi", "cace": "cace", "cace_se": "cace_se", "cace_low": f"cace - {Z95} * cace_se", "cace_high": f"cace + {Z95} * cace_se", "z": "z",
    "exposed_rate": "px", "never_taker_rate": "never", "complier_control_rate": "complier", "decomposition_cace": "px - complier",
    "wald_gap": "abs(cace - (px - complier))", "complier_relative_lift": "px / complier - 1", "naive_diff": "px - p_c", "naive_relative": "px / p_c - 1",
    "never_taker_gap": "never - p_c", "mde80_abs": f"{Z95 + Z80P} * sqrt(p_c * (1 - p_c)) * root", "mde80_rel": f"{Z95 + Z80P} * sqrt(p_c * (1 - p_c)) * root / p_c",
    "mde95_abs": f"{Z95 + Z95P} * sqrt(p_c * (1 - p_c)) * root", "mde95_rel": f"{Z95 + Z95P} * sqrt(p_c * (1 - p_c)) * root / p_c",
    "cohen_mde80": cohen(Z80P), "cohen_mde95": cohen(Z95P)}.items())
_CI = """CASE WHEN p_t IN (0, 1) OR p_c IN (0, 1) THEN 'unavailable' WHEN least(CASE WHEN y_t > 0 THEN y_t ELSE 10 END, CASE WHEN n_t > y_t THEN n_t - y_t ELSE 10 END,
  CASE WHEN y_c > 0 THEN y_c ELSE 10 END, CASE WHEN n_c > y_c THEN n_c - y_c ELSE 10 END) < 10 THEN 'approximate' ELSE 'ok' END"""
oracle("experiment_readout", f"""SELECT segment, {_SIX}, 'ok' AS status, {_CI} AS itt_ci_status, {_CI} AS cace_ci_status, {_READ} FROM @st@""")
oracle("experiment_overall", f"""SELECT {big('n_t', 'n_t')}, {big('y_t', 'y_t')}, {big('n_c', 'n_c')}, {big('y_c', 'y_c')}, {r6('d', 'itt')}, {r6(f'd - {Z95} * se', 'itt_low')},
  {r6(f'd + {Z95} * se', 'itt_high')}, {r6('cace', 'cace')}, {r6(f'cace - {Z95} * cace_se', 'cace_low')}, {r6(f'cace + {Z95} * cace_se', 'cace_high')} FROM @sa@""")


def smd(v: str, a: str, b: str, name: str) -> str:
    return r6(f"abs(avg({v}) FILTER ({a}) - avg({v}) FILTER ({b})) / sqrt((var_samp({v}) FILTER ({a}) + var_samp({v}) FILTER ({b})) / 2)", name)


oracle("covariate_balance", " UNION ALL ".join(
    f"""SELECT segment, '{v}' AS covariate, {smd(v, 'treatment = 1', 'treatment = 0', 'smd_treatment')},
    {smd(v, 'treatment = 1 AND exposure = 1', 'treatment = 1 AND exposure = 0', 'smd_exposure')} FROM @rct@ GROUP BY segment""" for v in ("f0", "f1")))
oracle("arm_descriptives", f"""SELECT CAST(treatment AS BIGINT) AS treatment, count(*) AS units, {r6('avg(visit)', 'visit_rate')}, {r6('avg(conversion)', 'conversion_rate')},
  {r6('avg(exposure)', 'exposure_rate')}, {r6('avg(f0)', 'f0_mean')}, {r6('avg(f1)', 'f1_mean')} FROM @rct@ GROUP BY treatment""")


def pays(effect: str, cost: str) -> str:
    return f"CASE WHEN {effect} > 0 THEN {cost} / (1000 * ({effect})) END"


_LO, _HI = f"(d - {Z95} * se)", f"(d + {Z95} * se)"
oracle("breakeven_values", f"""SELECT segment, {r6('1000 * d', 'incremental_per_1000')}, {r6(pays('d', '2.0'), 'breakeven_value')}, {r6(pays(_HI, '2.0'), 'breakeven_best')},
  {r6(pays(_LO, '2.0'), 'breakeven_worst')} FROM @st@""")
oracle("breakeven_exposed_basis", f"""SELECT segment, {r6('100 * pi', 'cost_per_1000_assigned')}, {r6('5000 * d - 100 * pi', 'net_per_1000')}, {r6(f'5000 * {_LO} - 100 * pi', 'net_low')},
  {r6(f'5000 * {_HI} - 100 * pi', 'net_high')}, {r6(pays('d', '100 * pi'), 'breakeven_value')} FROM @st@""")
oracle("exposure_trap", f"""SELECT {r6('d', 'itt')}, {r6('p_t / p_c - 1', 'relative_lift')}, {r6('px - p_c', 'naive_diff')}, {r6('px / p_c - 1', 'naive_relative')},
  {r6('never', 'never_taker_rate')}, {r6('never - p_c', 'never_taker_gap')}, {r6('(px / p_c - 1) / (p_t / p_c - 1)', 'overstatement')} FROM @sa@""")

SQL["category_view_sparse"] = SQL["category_view"].replace(f"label BETWEEN '{FIRST}' AND", f"label <> '{FIRST}' AND label BETWEEN '{FIRST}' AND")
oracle("month_selections", " UNION ALL ".join(
    f"""SELECT '{a}' AS first, '{b}' AS last, {f"'{a} lies after {b}'" if a > b else f"CASE WHEN count(DISTINCT label) FILTER (label IN ('{a}', '{b}')) < {len({a, b})} THEN 'no data for an end of {a}..{b}' END"} AS problem FROM {'(SELECT 1)' if a > b else '@mm@'}"""
    for a, b in ((FIRST, LAST), (FIRST, FIRST), ("2030-01", "2030-02"), (FIRST, "2030-01"), (LAST, FIRST))))


def feasible(case: str, change: dict[str, str], status: str, problems: str) -> str:
    cell = lambda name, n: f"CASE WHEN {n} = 0 THEN '{name}: empty, no interval' WHEN {n} < 10 THEN '{name}: under 10, interval is rough' END"
    notes = [cell("treated, converted", "y_t"), cell("treated, not converted", "n_t - y_t"), cell("control, converted", "y_c"), cell("control, not converted", "n_c - y_c"),
             "CASE WHEN y_t + y_c = 0 OR y_t + y_c = n_t + n_c THEN 'outcome does not vary: no z' END", "CASE WHEN n_exposed = 0 THEN 'nobody is exposed: no complier effect' END"]
    warnings = f"concat_ws('; ', {', '.join(notes)})" if status == "ok" else "''"
    ci = f"CASE WHEN y_t IN (0, n_t) OR y_c IN (0, n_c) THEN 'unavailable' WHEN {' OR '.join(f'({c} > 0 AND {c} < 10)' for c in ('y_t', 'n_t - y_t', 'y_c', 'n_c - y_c'))} THEN 'approximate' ELSE 'ok' END" if status == "ok" else "CAST(NULL AS VARCHAR)"
    source = "SELECT * REPLACE (" + ", ".join(f"{v} AS {c}" for c, v in change.items()) + ") FROM @ac@" if change else "SELECT * FROM @ac@"
    return f"SELECT segment, '{case}' AS \"case\", '{status}' AS status, {ci} AS itt_ci_status, '{problems}' AS problems, {warnings} AS warnings FROM ({source})"


oracle("experiment_feasibility", " UNION ALL ".join((
    feasible("as counted", {}, "ok", ""), feasible("too many", {"y_t": "n_t + 1"}, "invalid", "y_t: more than n_t; y_t - y_exposed: more than n_t - n_exposed"),
    feasible("below zero", {"n_c": "-1"}, "invalid", "n_c: below zero; y_c: more than n_c"), feasible("no count", {"y_exposed": "NULL"}, "invalid", "y_exposed: no count"),
    feasible("none converted", {"y_c": "0"}, "ok", ""), feasible("few converted", {"y_c": "3"}, "ok", ""),
    feasible("no arm", {"n_c": "0", "y_c": "0"}, "invalid", "n_c: an arm without units"))))


def tail_p(z: str) -> tuple[str, str]:
    """p and log10 p of a normal z: the power series of the error function below 8, the tail series beyond."""
    series = f"list_sum(list_transform(range(0, 220), lambda k: exp(k * ln(greatest({z} * {z}, 1e-300)) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1))))))"
    inner = f"1 - 2 * {z} * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series}"
    tail = f"1 - 1 / ({z} * {z}) + 3 / pow({z}, 4) - 15 / pow({z}, 6)"
    return inner, f"(ln(2) - {z} * {z} / 2 - ln(2 * pi()) / 2 - ln({z}) + ln({tail})) / ln(10)"


_P, _LOGP = tail_p("abs(z)")
oracle("experiment_p_values", f"""SELECT segment, {r6('z', 'z')}, {r6(f"CASE WHEN abs(z) >= 8 THEN 0.0 ELSE {_P} END", 'p_value')},
  {r6(f"CASE WHEN abs(z) >= 8 THEN {_LOGP} ELSE log10({_P}) END", 'log10_p')} FROM @st@""")
