import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from conftest import by_key, rows
from ledgerloom.plans import experiment as ex
from ledgerloom.sources.readers import read_documented_counts


def counts(spark, *values):
    return spark.createDataFrame([values], ", ".join(f"{c} long" for c in ex.COUNTS))


def units(spark, data, schema="treatment int, conversion int, exposure int"):
    return spark.createDataFrame(data, schema)


def test_documented_counts(spark):
    r = rows(ex.analyse_counts(counts(spark, 11882655, 36711, 2096937, 4063, 428212, 23031)))[0]
    near = lambda v, digits: round(100 * v, digits)
    assert near(r["itt"], 4) == 0.1152 and near(r["itt_low"], 4) == 0.1085 and near(r["itt_high"], 4) == 0.1219
    assert near(r["relative_lift"], 2) == 59.45 and near(r["compliance"], 4) == 3.6037 and near(r["cace"], 4) == 3.1964
    assert near(r["complier_control_rate"], 3) == 2.182 and near(r["complier_relative_lift"], 2) == 146.49
    assert near(r["naive_relative"], 2) == 2675.83 and near(r["never_taker_rate"], 4) == 0.1194
    assert near(r["cohen_mde80"], 4) == 0.0093 and near(r["cohen_mde95"], 4) == 0.0121 and round(r["z"], 2) == 28.52
    assert r["wald_gap"] < 1e-12 and r["log10_p"] < -170


def test_second_documented_counts(spark):
    r = rows(ex.analyse_counts(counts(spark, 203854, 1615, 36146, 224, 12556, 649)))[0]
    assert r["itt"] == pytest.approx(0.0017252469930717374) and r["itt_low"] == pytest.approx(0.0008293515, abs=1e-10)
    assert r["cace"] == pytest.approx(0.0280103935, abs=1e-10) and r["cace_low"] == pytest.approx(0.0134830603, abs=1e-10)
    assert r["mde80_abs"] == pytest.approx(0.0012547689, abs=1e-10) and r["cohen_mde80"] == pytest.approx(0.0013178335, abs=1e-10)
    assert r["log10_p"] == pytest.approx(-3.2783344563, abs=1e-9) and r["itt_ci_status"] == "ok"


def test_log_p_is_continuous_at_the_switch(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.normal import log10_two_sided_p

    df = spark.createDataFrame([(z,) for z in (0.5, 7.999999, 8.000001, 40.0, -3.0)], "z double")
    got = {r["z"]: r["p"] for r in df.select("z", log10_two_sided_p(F.col("z")).alias("p")).collect()}
    assert got[7.999999] == pytest.approx(got[8.000001], abs=1e-3)
    assert got[-3.0] == pytest.approx(math.log10(2 * (1 - NormalDist().cdf(3))), abs=1e-9) and -360 < got[40.0] < -340


def test_boundary_small_and_infeasible_cells(spark):
    zero = rows(ex.analyse_counts(counts(spark, 100, 5, 100, 0, 10, 1)))[0]
    assert zero["itt_ci_status"] == "unavailable" and zero["itt_se"] is None and zero["itt"] == 0.05
    assert zero["relative_lift"] is None and zero["mde80_abs"] is None and zero["cohen_mde80"] is None
    small = rows(ex.analyse_counts(counts(spark, 100, 5, 100, 20, 10, 1)))[0]
    assert small["itt_ci_status"] == "approximate"
    bad = rows(ex.analyse_counts(counts(spark, 100, 5, 0, 3, 200, 300)))[0]
    assert bad["status"] == "invalid" and len(bad["problems"]) >= 4 and bad["itt"] is None and bad["cace"] is None
    nobody = rows(ex.analyse_counts(counts(spark, 100, 20, 100, 20, 0, 0)))[0]
    assert nobody["cace"] is None and nobody["cace_ci_status"] == "unavailable" and nobody["itt"] == 0.0


@pytest.mark.parametrize("row,text", [((None, 0, 0), "treatment"), ((1, 2, 0), "conversion"), ((1, 0, None), "exposure"), ((0, 0, 1), "control")])
def test_bad_units_fail_the_query(spark, row, text):
    with pytest.raises(PySparkException, match=text):
        ex.arm_counts(units(spark, [(1, 1, 1), (0, 0, 0), row])).collect()


def test_arm_counts_per_segment(spark):
    data = [("a", 1, 1, 1), ("a", 1, 0, 0), ("a", 0, 1, 0), ("b", 0, 0, 0), ("b", 1, 1, 0)]
    got = by_key(ex.arm_counts(units(spark, data, "seg string, treatment int, conversion int, exposure int"), ["seg"]), "seg")
    assert [got["a"][c] for c in ex.COUNTS] == [2, 1, 1, 1, 1, 1] and [got["b"][c] for c in ex.COUNTS] == [1, 1, 1, 0, 0, 0]


def test_balance(spark):
    data = [(1, 0, 1, 1.0), (1, 0, 1, 3.0), (1, 0, 0, 2.0), (1, 0, 0, 4.0), (0, 0, 0, 1.0), (0, 0, 0, 2.0)]
    got = rows(ex.balance(units(spark, data, "treatment int, conversion int, exposure int, f0 double"), ["f0"]))[0]
    assert got["smd_exposure"] == pytest.approx(1 / math.sqrt(2))
    var_t, var_c = 5 / 3, 0.5
    assert got["smd_treatment"] == pytest.approx((2.5 - 1.5) / math.sqrt((var_t + var_c) / 2))


def test_breakeven(spark):
    df = spark.createDataFrame([(0.001, -0.0005, 0.002, 0.03)], "itt double, itt_low double, itt_high double, compliance double")
    got = rows(ex.breakeven_net(df, 2.0, 5.0))[0]
    assert got["breakeven_value"] == pytest.approx(2.0) and got["net_per_1000"] == pytest.approx(3.0) and got["breakeven_worst"] is None
    assert rows(ex.breakeven_net(df, 100.0, 5.0, "exposed"))[0]["cost_per_1000_assigned"] == pytest.approx(3.0)
    assert rows(ex.breakeven(df, 2.0))[0]["breakeven_best"] == pytest.approx(1.0)
    for bad in (dict(cost=-1, value=1), dict(cost=1, value=math.inf), dict(cost=1, value=1, basis="x")):
        with pytest.raises(ValueError):
            ex.breakeven_net(df, **bad)


def test_counts_from_document(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"note": 1,\n "counts": {"n_t": 10, "y_t": 4, "n_c": 8, "y_c": 2, "n_exposed": 3},\n "inferred": {"y_exposed": {"value": 2}}}')
    got = rows(read_documented_counts(spark, str(tmp_path / "c.json")))[0]
    assert [got[c] for c in ex.COUNTS] == [10, 4, 8, 2, 3, 2]


def test_tail_areas_are_column_arithmetic(spark):
    """To thirteen digits of the library function, on both sides of the joint, without Python in the plan."""
    import math

    from ledgerloom.functions.normal import two_sided_p

    zs = [0.0, -0.0, 1e-9, 0.3, -1.96, 2.5, 2.999999, 3.0, 3.000001, -4.4, 7.99, 12.0, 25.0, 37.0, 39.0, 1e6]
    df = spark.createDataFrame([(z,) for z in zs] + [(None,), (float("nan"),)], "z double").select("z", two_sided_p(F.col("z")).alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    for r in got[:-2]:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-12, abs=1e-300), r
    assert [r["p"] for r in got[-2:]] == [None, None]
