from pyspark.sql import functions as F

from conftest import by_key, rows
from ledgerloom import session
from ledgerloom.plans import staging
from ledgerloom.sources import readers, sinks
from market import CUSTOMERS, ORDERS, Market


def test_csv_source_keeps_text_ids(spark, tmp_path):
    header = "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state"
    (tmp_path / "customers.csv").write_text("\n".join([header, *[",".join(r) for r in CUSTOMERS]]) + "\n")
    got = by_key(staging.staged(readers.read_raw(spark, str(tmp_path / "customers.csv"), "customers"), "customers"), "customer_id")
    assert got["a1"]["customer_zip_prefix"] == "01001" and got["a1"]["customer_state"] == "SP" and len(got) == 9


def test_csv_timestamps(spark, tmp_path):
    header = ("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
              "order_delivered_customer_date,order_estimated_delivery_date")
    (tmp_path / "orders.csv").write_text("\n".join([header, *[",".join(v or "" for v in r) for r in ORDERS]]) + "\n")
    got = by_key(staging.orders(readers.read_raw(spark, str(tmp_path / "orders.csv"), "orders")), "order_id")
    assert got["o01"]["delivery_days_vs_estimate"] == 0 and got["o02"]["delivery_days_vs_estimate"] == 1 and got["o03"]["delivered_at"] is None


def test_counts_and_column_scan(spark):
    tables = {"a": spark.createDataFrame([(1, 2)], "id int, unit_cost int"), "b": spark.createDataFrame([], "x int")}
    assert by_key(readers.row_counts(tables), "table_name") == {"a": {"table_name": "a", "n_rows": 1}, "b": {"table_name": "b", "n_rows": 0}}
    hits = by_key(readers.scan_columns(spark, tables), "table_name")
    assert hits["a"]["n_hits"] == 1 and hits["b"]["n_hits"] == 0 and hits["a"]["n_columns"] == 2


def test_export_is_ordered_and_verified(spark, tmp_path):
    mart = Market(spark).monthly
    got = rows(sinks.verified_export(mart, str(tmp_path / "m"), "gmv_brl", ["purchase_month"]))[0]
    assert got["verified"] and got["rows_found"] == 3 and got["nulls_found"] == 1 and got["cents_found"] == 18430
    lines = [x for p in sorted((tmp_path / "m").glob("part-*.csv")) for x in p.read_text().splitlines() if not x.startswith("purchase_month")]
    assert [x[:7] for x in lines] == ["2017-01", "2017-02", "2017-03"] and ",," in lines[2]


def test_failed_export_is_removed(spark, tmp_path):
    """Files that do not carry every row back must not stay."""
    df = spark.createDataFrame([("x",)], "k string").withColumn("gmv_brl", F.lit("1.00").cast("decimal(10,2)"))

    target = str(tmp_path / "bad")
    original = sinks.export_csv
    try:
        sinks.export_csv = lambda frame, path, order: original(frame.limit(0), path, order)
        got = rows(sinks.verified_export(df, target, "gmv_brl"))[0]
    finally:
        sinks.export_csv = original
    assert not got["verified"] and not (tmp_path / "bad").exists()


def test_scores_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("b", 1, 0.1), ("a", 0, 0.1), ("c", 0, 0.7123456789012345)], "id string, label int, score double")
    sinks.export_ranked_scores(scores, str(tmp_path / "s"), "score", "id")
    back = readers.read_scores(spark, str(tmp_path / "s"), "id", "label", ["score"])
    assert {(r["id"], r["label"], r["score"]) for r in back.collect()} == {("b", 1, 0.1), ("a", 0, 0.1), ("c", 0, 0.7123456789012345)}
    text = [x for p in sorted((tmp_path / "s").glob("part-*.csv")) for x in p.read_text().splitlines()[1:]]
    assert [x[0] for x in text] == ["c", "a", "b"]


def test_layers(spark):
    name = sinks.save_layer(spark.range(3).withColumn("m", F.lit("2017-01")), "layer_test", "numbers", ["m"])
    bucketed = sinks.save_bucketed(spark.range(3), "layer_test", "bucketed", "id", 4)
    try:
        assert spark.table(name).count() == 3 and spark.table(bucketed).count() == 3
        plan = spark.table(bucketed).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP DATABASE layer_test CASCADE")


def test_staged_tables_live_in_the_session_folder(spark, tmp_path):
    root = session.staging_root(spark)
    with session.staged(spark.range(5), "t") as table:
        path = table.inputFiles()[0]
        assert root in path and table.count() == 5
    assert not session.remove_path(spark, path.rsplit("/", 1)[0])


def test_staged_tables_can_be_released(spark):
    table, path = session.stage(spark.range(4), "r")
    assert table.count() == 4 and session.release_staged(spark) >= 1
    assert not session.remove_path(spark, path)


def test_replacing_a_month_leaves_the_files_of_others(spark, tmp_path):
    spark.sql(f"CREATE DATABASE month_files LOCATION '{tmp_path}/month_files'")
    fact = spark.range(600).select("id", (F.col("id") % 10).alias("v"), F.concat(F.lit("2020-0"), F.col("id") % 3 + 1).alias("month"))
    table = sinks.save_fact(fact, "month_files.fact", "month", "id", 2)
    files = lambda m: {r[0] for r in spark.table(table).where(F.col("month") == m).select(F.input_file_name()).distinct().collect()}
    before = {m: files(m) for m in ("2020-01", "2020-02", "2020-03")}
    assert all(len(x) == 2 for x in before.values())
    sinks.replace_months(fact.withColumn("v", F.lit(99).cast("long")), table, "month", "id", 2, ["2020-02"])
    spark.catalog.refreshTable(table)
    assert files("2020-01") == before["2020-01"] and files("2020-03") == before["2020-03"] and not files("2020-02") & before["2020-02"]
    got = {r["month"]: (r["n"], r["v"]) for r in spark.table(table).groupBy("month").agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()}
    assert got == {"2020-01": (200, 9), "2020-02": (200, 99), "2020-03": (200, 9)}
    both = spark.table(table).hint("merge").join(spark.table(table).withColumnRenamed("v", "w"), "id").groupBy("id").agg(F.sum("w").alias("w"))
    assert sinks.exchanges(both) == [] and both.count() == 600
    assert sinks.exchanges(fact.groupBy("v").count())


def test_order_of_files_is_proved_or_refuted(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 40).alias("k"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("s"), F.col("id").alias("u"))

    def proof(order, claimed, **conf):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        sinks.export_csv(df, path, order)
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf.get("block", "128m"))
        try:
            return sinks.files_in_order(spark.read.schema(df.schema).option("header", True).csv(path), claimed).first().asDict()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    by = [F.desc("k"), F.asc("s"), F.asc("u")]
    for block in ("128m", "700"):
        got = proof(by, by, block=block)
        assert got["in_order"] and got["n_rows"] == 1000 and (got["n_blocks"] > 8 or block == "128m")
        assert proof(by, [F.desc("k")], block=block)["in_order"] and not proof(by, ["k"], block=block)["in_order"]
        assert not proof(by, [F.desc("k"), F.desc("s")], block=block)["in_order"] and not proof([F.asc("u")], by, block=block)["in_order"]


def test_checks_are_taken_while_writing(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    got = {r["check_name"]: r["value"] for r in sinks.save_checked(df, str(tmp_path / "fact"), {"rows": F.count("*"), "null v": F.count_if(F.col("v").isNull()), "sum": F.sum("v")}).collect()}
    assert got == {"rows": 500, "null v": 100, "sum": sum(i for i in range(500) if i % 5)} and spark.read.parquet(str(tmp_path / "fact")).count() == 500
