import csv

import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows
from ledgerloom.functions.text import finite_number, money_cents, month_problem, whole_count
from ledgerloom.operators import extracts, infer
from ledgerloom.operators.grain import ContractBroken
from ledgerloom.plans import rollups
from ledgerloom.sources.schemas import EXTRACT_COLUMNS, EXTRACT_COMPONENTS
from market import Market


@pytest.fixture(scope="module")
def table_rows(spark):
    """The market's four marts as lists of text rows."""
    m = Market(spark)
    out = {}
    for name, mart in (("monthly", m.monthly), ("category", m.category), ("state", m.state), ("payment", m.payment)):
        text = mart.select(*[F.col(c).cast("string").alias(c) for c in mart.columns])
        out[name] = (text.columns, [[v if v is not None else "" for v in r] for r in text.orderBy(*text.columns[:3]).collect()])
    return out


def write(folder, tables):
    paths = {}
    for name, (header, data) in tables.items():
        path = folder / f"{name}.csv"
        with open(path, "w", newline="") as fh:
            w = csv.writer(fh, lineterminator="\n")
            w.writerow(header)
            w.writerows(data)
        paths[name] = str(path)
    return paths


def changed(tables, name, column, value, row=0):
    header, data = tables[name]
    data = [list(r) for r in data]
    data[row][header.index(column)] = value
    return {**tables, name: (header, data)}


def without_components(tables):
    out = {}
    for name, (header, data) in tables.items():
        keep = [i for i, c in enumerate(header) if c in EXTRACT_COLUMNS[name]]
        out[name] = ([header[i] for i in keep], [[r[i] for i in keep] for r in data])
    return out


def test_good_extracts_load(spark, table_rows, tmp_path):
    loaded = extracts.load_extracts(spark, write(tmp_path, table_rows)).require()
    assert loaded.components == {n: True for n in EXTRACT_COMPONENTS} and loaded.inference_log is None
    results = {r["result"] for r in loaded.reconciliation.collect()}
    assert results == {"pass", "bounded"}
    jan = by_key(loaded.monthly, "month_label")["2017-01"]
    assert jan["gmv_c"] == 5930 and jan["low_score_orders_status"] == "observed"
    assert by_key(loaded.monthly, "month_label")["2017-03"]["gmv_c"] is None


def test_older_extracts_are_inferred_and_bounded(spark, table_rows, tmp_path):
    loaded = extracts.load_extracts(spark, write(tmp_path, without_components(table_rows))).require()
    log = by_key(loaded.inference_log, "key")
    assert log["2017-01/SP"]["status"] == "inferred" and log["2017-01/SP"]["value"] == 2
    assert log["2017-03/SP"]["status"] == "unavailable"
    got = {(r["check_name"], r["month_label"]): r["result"] for r in loaded.reconciliation.collect()}
    assert got["payment orders with items, excluded unknown", "2017-02"] == "unsupported"
    assert got["payment GMV", "2017-01"] == "pass" and got["payment GMV, part of month", "2017-02"] == "bounded"
    counts = {(r["field"], r["status"]): r["n"] for r in rollups.status_counts(loaded.inference_log, ["field", "status"]).collect()}
    assert counts["orders_with_items", "unavailable"] >= 1


@pytest.mark.parametrize("name,column,value,text", [
    ("monthly", "gmv_brl", "1e3", "gmv_brl"), ("monthly", "gmv_brl", "59.301", "gmv_brl"), ("monthly", "orders", "2.5", "orders"),
    ("monthly", "orders", "-3", "orders"), ("monthly", "orders", "", "required"), ("monthly", "avg_review_score", "NaN", "avg_review_score"),
    ("monthly", "avg_review_score", "1e999", "avg_review_score"), ("monthly", "gmv_brl", "Infinity", "gmv_brl"),
    ("monthly", "month_label", "2017-1", "label is no YYYY-MM"), ("monthly", "purchase_month", "2017-01-02", "date is no first of a month"),
    ("monthly", "month_label", "2017-04", "name different months"), ("monthly", "late_orders", "4", "late within delivered"),
    ("monthly", "active_customers", "99", "active_customers within orders"), ("monthly", "goods_brl", "1.00", "goods and freight"),
    ("monthly", "orders", "0", "a month has orders"), ("category", "product_category", "", "product_category"),
    ("category", "orders", "99", "orders between 1 and lines"), ("payment", "installment_orders", "99", "installment orders"),
    ("state", "orders", "2", "state orders"), ("category", "order_lines", "abc", "order_lines"),
])
def test_a_changed_cell_is_caught(spark, table_rows, tmp_path, name, column, value, text):
    loaded = extracts.load_extracts(spark, write(tmp_path, changed(table_rows, name, column, value)))
    problems = [r["problem"] for r in loaded.violations.collect()]
    assert any(text in p for p in problems), problems


def test_file_level_defects(spark, table_rows, tmp_path):
    header, data = table_rows["state"]

    def problems(tables):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        loaded = extracts.load_extracts(spark, write(folder, tables))
        return {r["problem"] for r in loaded.violations.collect()}

    assert "duplicate key" in problems({**table_rows, "state": (header, data + [data[0]])})
    assert "wrong number of fields" in problems({**table_rows, "state": (header, data + [data[0][:4]])})
    assert "no data rows" in problems({**table_rows, "payment": (table_rows["payment"][0], [])})
    months = table_rows["monthly"]
    assert "months are not contiguous" in problems({**table_rows, "monthly": (months[0], [months[1][0], months[1][2]])})
    with pytest.raises(ContractBroken, match="duplicate columns"):
        problems({**table_rows, "state": ([*header[:-1], header[0]], data)})
    with pytest.raises(ContractBroken, match="missing columns"):
        problems({**table_rows, "state": ([c if c != "orders" else "ordres" for c in header], data)})


def test_month_outside_the_parent(spark, table_rows, tmp_path):
    header, data = table_rows["monthly"]
    loaded = extracts.load_extracts(spark, write(tmp_path, {**table_rows, "monthly": (header, data[:2])}))
    assert "month outside the monthly extract" in {r["problem"] for r in loaded.violations.collect()}


@pytest.mark.parametrize("parser,good,bad", [
    (money_cents, {"1234.56": 123456, "-1.5": -150, "7": 700, "1.230": 123, ".5": 50, "": None, None: None}, ["1e3", "0.001", "NaN", "Infinity", "x", "1,5", "."]),
    (whole_count, {"5": 5, "5.0": 5, "1e3": 1000, "0": 0, "": None, None: None}, ["5.5", "-1", "NaN", "Infinity", "x", "0.0000000000001"]),
    (finite_number, {"1.5": 1.5, "1e-05": 1e-5, "-2": -2.0, "": None, None: None}, ["NaN", "Infinity", "1e999", "1d", "x"]),
])
def test_parsers(spark, parser, good, bad):
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r["t"]: (r["p"]["value"], r["p"]["problem"]) for r in df.selectExpr("t", f"{parser('t')} AS p").collect()}
    assert {t: got[t] for t in good} == {t: (v, None) for t, v in good.items()}
    assert all(got[t][0] is None and t in got[t][1] for t in bad)


def test_month_labels(spark):
    df = spark.createDataFrame([("2017-01", "2017-01-01"), ("2017-01", "2017-01-01 00:00:00"), ("2017-13", "2017-01-01"), (None, "2017-01-01")], "month_label string, purchase_month string")
    got = [r["p"] for r in df.selectExpr(f"{month_problem()} AS p").collect()]
    assert got[:2] == [None, None] and all(got[2:])
    assert extracts.month_contract(df).count() == 2


def infer_one(spark, kind, *args):
    if kind == "k":
        df = spark.createDataFrame([args], "rate string, den long")
        value = infer.infer_numerator(F.col("rate"), F.col("den"))
    else:
        df = spark.createDataFrame([args], "num string, ratio string, hi long")
        value = infer.aov_denominator(F.col("num"), F.col("ratio"), F.col("hi"))
    r = df.select(value.alias("i")).first()["i"]
    return r["value"], r["status"], r["candidates"]


def test_inference(spark):
    assert infer_one(spark, "k", "5.3784", 428212) == (23031, "inferred", 1)
    assert infer_one(spark, "k", "50.0", 3) == (None, "unavailable", 0)
    assert infer_one(spark, "k", "50", 400)[1:] == ("unavailable", 5)
    assert infer_one(spark, "k", None, 10)[1] == "unavailable" and infer_one(spark, "k", "1.0", 0)[1] == "unavailable"
    assert infer_one(spark, "n", "100.00", "33.3333333", 5) == (3, "inferred", 1)
    assert infer_one(spark, "n", "100.00", "33.34", 5)[1] == "unavailable"
    assert infer_one(spark, "n", "0.00", "0.0", 1) == (1, "inferred", 1) and infer_one(spark, "n", "0.00", "0.0", 4)[2] == 4
    assert infer_one(spark, "n", None, "1.0", 4)[1] == "unavailable" and infer_one(spark, "n", "5.00", "-1.0", 4)[1] == "unavailable"
    assert infer_one(spark, "n", "100.00", "0.01", 2)[2] == 0 and infer_one(spark, "n", "1.00", "1e-05", 200000)[2] > 1


def test_header_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b,c",d\n1,2,3\n')
    assert extracts.read_header(spark, str(tmp_path / "a.csv")) == ["a", "b,c", "d"]
    (tmp_path / "e.csv").write_text("")
    assert extracts.header_problems(extracts.read_header(spark, str(tmp_path / "e.csv")), ["a"]) == ["no header"]


def test_violations_key(spark, table_rows, tmp_path):
    loaded = extracts.load_extracts(spark, write(tmp_path, changed(table_rows, "state", "orders", "x")))
    assert rows(loaded.violations.where("extract = 'state'"))[0]["row_key"].startswith("2017-01/")
    with pytest.raises(ContractBroken, match="state 2017-01/"):
        loaded.require()
