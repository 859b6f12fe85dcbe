import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows
from ledgerloom.operators import grain
from ledgerloom.operators.point_in_time import prior_and_full_counts, prior_count_by_range
from ledgerloom.plans import cohorts, lead_features as lf, marts

D = dt.date
C = D(2018, 1, 10)


def tables(spark, leads, deals):
    a = spark.createDataFrame(leads, "mql_id string, first_contact_date date, landing_page_id string, lead_origin_channel string")
    b = spark.createDataFrame(deals, "mql_id string, won_at timestamp_ntz")
    return a, b


def at(days, hour=12):
    return dt.datetime.combine(C, dt.time(hour)) + dt.timedelta(days=days)


@pytest.fixture(scope="module")
def features(spark):
    leads = [("w90", C, "p", None), ("w91", C, "p", "email"), ("w0", C, "q", "email"), ("wm2", C, "p", "email"),
             ("none", C, None, "email"), ("later", C + dt.timedelta(days=4), "p", "social"), ("early", C - dt.timedelta(days=1), "p", "social")]
    deals = [("w90", at(90, 23)), ("w91", at(91, 0)), ("w0", at(0)), ("wm2", at(-2))]
    return lf.lead_features(*tables(spark, leads, deals))


def test_label_boundaries(features):
    got = by_key(features, "mql_id")
    assert {k: got[k]["is_won"] for k in ("w90", "w91", "w0", "wm2", "none")} == {"w90": True, "w91": False, "w0": True, "wm2": False, "none": False}
    assert got["wm2"]["is_won_ever"] and got["wm2"]["days_to_win"] == -2 and got["w90"]["label_mature_on"] == C + dt.timedelta(days=91)


def test_prior_counts_skip_same_day_and_null_page(features):
    got = by_key(features, "mql_id")
    assert (got["early"]["page_lead_volume_prior"], got["w90"]["page_lead_volume_prior"], got["later"]["page_lead_volume_prior"]) == (0, 1, 4)
    assert got["none"]["page_lead_volume_prior"] == 0 and got["none"]["page_lead_volume"] is None and got["w90"]["page_lead_volume"] == 5


def test_channel_and_weekday_bases(features):
    got = by_key(features, "mql_id")
    assert got["w90"]["lead_origin_channel"] == "not_recorded"
    sunday = by_key(lf.design_matrix(features), "mql_id")["later"]  # 2018-01-14
    assert sunday["contact_dow"] == 0 and sunday["contact_weekday"] == 6.0 and sunday["is_weekend"] == 1.0 and sunday["is_weekend_contact"]


def test_label_visible_only_after_the_win(features):
    seen = lambda day: by_key(lf.label_as_of(features, day.isoformat(), 90), "mql_id")["w90"]["label"]
    assert seen(C + dt.timedelta(days=90)) == 0 and seen(C + dt.timedelta(days=91)) == 1


def test_contract_holds_and_catches_a_wrong_label(features):
    assert grain.lead_label_contract(features, 90).count() == 0
    broken = features.withColumn("is_won", F.when(F.col("mql_id") == "w91", True).otherwise(F.col("is_won")))
    assert [r["mql_id"] for r in grain.lead_label_contract(broken, 90).collect()] == ["w91"]
    early = features.withColumn("page_lead_volume_prior", F.when(F.col("mql_id") == "early", 2).otherwise(F.col("page_lead_volume_prior")))
    assert [r["mql_id"] for r in grain.lead_label_contract(early, 90).collect()] == ["early"]


def random_leads(spark, seed, n=120):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, C + dt.timedelta(days=rng.randrange(20)), rng.choice(["a", "a", "a", "b", None])) for i in range(n)],
                                 "id int, day date, page string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prior_counts_against_brute_force_and_future_changes(spark, seed):
    df = random_leads(spark, seed)
    got = by_key(prior_and_full_counts(df, "page", "day", "prior", "full"), "id")
    data = df.collect()
    for r in data:
        assert got[r["id"]]["prior"] == sum(1 for x in data if x["page"] == r["page"] is not None and x["day"] < r["day"])
    cut = C + dt.timedelta(days=10)
    changed = df.withColumn("page", F.when(F.col("day") >= F.lit(cut), "b").otherwise(F.col("page")))
    after = by_key(prior_and_full_counts(changed, "page", "day", "prior", "full"), "id")
    early = [r["id"] for r in data if r["day"] < cut]
    assert all(got[i]["prior"] == after[i]["prior"] for i in early)
    assert any(got[i]["full"] != after[i]["full"] for i in early)  # the look-ahead count does change
    ranged = by_key(prior_count_by_range(df, "page", "day", "p"), "id")
    assert all(ranged[i]["p"] == got[i]["prior"] for i in ranged)


def design(**change):
    base = dict(name="d", learn_from=D(2018, 1, 1), cut=D(2018, 5, 1), judge=cohorts.Days(D(2018, 5, 1), D(2018, 5, 31)), seen_to=D(2018, 8, 29))
    return cohorts.CohortDesign(**{**base, **change})


def test_design_dates_and_refusals():
    assert design().problems() == [] and design().settled == D(2018, 5, 1) - dt.timedelta(days=91) == design().learn.last
    early = cohorts.Days(D(2018, 4, 1), D(2018, 4, 30))
    assert any("training" in p for p in design(cut=D(2018, 4, 1), judge=early).problems())
    assert any("ahead of the cut" in p for p in design(judge=cohorts.Days(D(2018, 4, 30), D(2018, 5, 31))).problems())
    assert any("outcomes are open" in p for p in design(seen_to=D(2018, 8, 28)).problems())
    assert any(p.endswith("empty") for p in design(judge=cohorts.Days(D(2018, 5, 2), D(2018, 5, 1))).problems())
    assert any("features" in p for p in design(features="x").problems())
    assert design(learn_to=D(2018, 4, 30)).learn.last == D(2018, 4, 30) and design().describe()["gap_days"] == 90


def test_historical_split_is_immature(features):
    got = rows(lf.audit_split(features, "2018-01-01", "2018-03-31", "2018-04-01", 90))[0]
    assert got["share_usable_at_cut"] == 0.0 and got["latest_contact_usable"] == D(2017, 12, 31)
    assert rows(lf.immature_labels(features, "2018-04-11", 90))[0]["immature"] == 1


def lead_population(spark, n=1500):
    """Leads whose chance to win depends on the channel."""
    rng = random.Random(5)
    chance = {"email": 0.05, "organic": 0.2, "paid": 0.5}
    out = []
    for i in range(n):
        day = D(2018, 1, 1) + dt.timedelta(days=rng.randrange(151))
        channel = rng.choice(list(chance))
        won = day + dt.timedelta(days=rng.randrange(20)) if rng.random() < chance[channel] else None
        out.append((f"m{i:05d}", day, won, channel if rng.random() > 0.02 else None, rng.randrange(40), rng.randrange(60)))
    return spark.createDataFrame(out, "mql_id string, first_contact_date date, won_date date, lead_origin_channel string, page_lead_volume_prior int, page_lead_volume int")


def test_run_design_ranks_better_than_chance(spark):
    run = cohorts.run_design(lead_population(spark), design(), rounds=5)
    assert run.status == "ok" and run.summary["train_labels_immature_at_as_of"] == 0
    got = by_key(run.metrics, "model")
    assert set(got) == {"score_base", "score_channel", "score_lr", "score_gb"}
    assert got["score_base"]["auc"] == pytest.approx(0.5) and got["score_lr"]["auc"] > 0.65 and got["score_gb"]["auc"] > 0.6
    assert got["score_base"]["distinct_scores"] == 1 and got["score_base"]["top_tie_block"] == run.summary["score_n"]
    assert run.weights.first()["feature"].startswith("channel=") and run.design["problems"] == []
    assert cohorts.penalised_gradient(run.inputs, run.logistic).first()["largest"] < 0.05


def test_fits_read_each_distinct_case_once(spark, monkeypatch):
    """The passes of a fit grow with the distinct inputs: twenty times the leads are as many cases, of twenty times the weight."""
    read = {}
    for name in ("fit_logistic", "fit_boosted"):
        fit = getattr(cohorts, name)
        monkeypatch.setattr(cohorts, name, lambda train, *a, _n=name, _fit=fit: read.setdefault(_n, []).append(train) or _fit(train, *a))
    few = lead_population(spark, 200)
    many = few.crossJoin(spark.range(20)).withColumn("mql_id", F.concat("mql_id", F.lit("-"), F.col("id").cast("string"))).drop("id")
    runs = [cohorts.run_design(x, design(), rounds=2) for x in (few, many)]
    for name in ("fit_logistic", "fit_boosted"):
        a, b = read[name]
        assert a.count() == b.count() < runs[1].summary["train_n"] / 10
        assert [x.agg(F.sum("weight")).first()[0] for x in (a, b)] == [r.summary["train_n"] for r in runs]
    assert runs[1].inputs.count() == runs[1].summary["train_n"]


def test_weighed_cases_fit_as_their_rows_do(spark):
    rows_ = lf.design_matrix(design().training(lead_population(spark, 600))).withColumn("log_page_volume", F.round("log_page_volume"))
    enc = cohorts.fit_encoder(rows_)
    each, cases = enc.transform(rows_), enc.transform(cohorts.distinct_cases(rows_))
    n = each.count()
    assert cases.count() < n
    for a, b in ((cohorts.fit_logistic(each, n), cohorts.fit_logistic(cases, n, "weight")),
                 (cohorts.fit_boosted(each, 8), cohorts.fit_boosted(cases, 8, "weight"))):
        p = [[r["p"] for r in cohorts.positive_probability(m, cases, "p").orderBy("channel", *lf.NUMERIC_FEATURES, "label").collect()] for m in (a, b)]
        assert p[0] == pytest.approx(p[1], abs=1e-5)


def test_run_design_after_an_observed_export(spark):
    """A session in which something was observed can't be sent to tasks, so the fitted model must not hold it."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 3}
    run = cohorts.run_design(lead_population(spark, 300), design(), boosted=False)
    assert run.scores.where("score_lr BETWEEN 0 AND 1").count() == run.summary["score_n"] > 0


def test_logistic_matches_a_direct_optimum(spark):
    """The fit minimises summed log loss plus half the squared weights, intercept free."""
    import numpy as np

    leads = lead_population(spark, 400)
    train = lf.design_matrix(design().training(leads))
    enc = cohorts.fit_encoder(train)
    inputs = enc.transform(train)
    model = cohorts.fit_logistic(inputs, train.count())
    data = inputs.select("label", "features").collect()
    x = np.array([[1.0, *r["features"].toArray()] for r in data])
    y = np.array([r["label"] for r in data], dtype=float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    assert np.allclose(model.coefficients.toArray(), w[1:], atol=1e-3) and model.intercept == pytest.approx(w[0], abs=1e-3)


def test_invalid_designs_return_reasons(spark):
    leads = lead_population(spark, 200)
    assert cohorts.run_design(leads, design(cut=D(2018, 4, 1), judge=cohorts.Days(D(2018, 4, 1), D(2018, 4, 30)))).status == "invalid"
    never = leads.withColumn("won_date", F.lit(None).cast("date"))
    run = cohorts.run_design(never, design())
    assert run.status == "invalid" and "one label class" in run.problems[0] and run.summary["train_positives"] == 0


def test_lag_distribution_and_cardinality(features):
    got = rows(marts.lag_distribution(features))[0]
    assert (got["wins"], got["min_days"], got["max_days"], got["median_days"]) == (4, -2, 91, 45.0)
    assert rows(marts.key_cardinality(features, "landing_page_id"))[0] == {"distinct_keys": 2, "single_row_keys": 1, "largest_group": 5}


def test_many_channels_stay_sparse_and_on_the_jvm(spark):
    """50,000 levels: a row has one indicator and the numbers, the plan has no Python node, and the gradient has a term for each input of a row."""
    n = 50_000
    names = F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0"))
    train = spark.range(n).select(names.alias("channel"), (F.col("id") % 7 == 0).cast("int").alias("label"), *[(F.col("id") % (5 + i)).cast("double").alias(c) for i, c in enumerate(lf.NUMERIC_FEATURES)])
    enc = cohorts.fit_encoder(train)
    out = enc.transform(train.union(train.limit(1).withColumn("channel", F.lit("never seen"))))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r["channel"]: r["features"] for r in out.where("channel IN ('c000000', 'c000001', 'c049999', 'never seen')").collect()}
    wide, numbers = n - 1, len(lf.NUMERIC_FEATURES)
    assert all(v.size == wide + numbers for v in rows.values())
    active = {c: [int(i) for i in v.indices if i < wide] if hasattr(v, "indices") else None for c, v in rows.items()}
    assert active == {"c000000": [], "c000001": [0], "c049999": [wide - 1], "never seen": []}

    class Fitted:
        intercept = 0.25

        class coefficients:  # noqa: N801
            @staticmethod
            def toArray():  # noqa: N802
                import numpy as np

                return np.concatenate((np.full(wide, 0.5), np.zeros(numbers)))

    gradient = cohorts.penalised_gradient(out.where("channel <> 'never seen'"), Fitted)
    assert "Python" not in gradient._jdf.queryExecution().executedPlan().toString()
    got = gradient.first()
    p, p0 = 1 / (1 + 2.718281828459045 ** -0.75), 1 / (1 + 2.718281828459045 ** -0.25)
    positives = sum(i % 7 == 0 for i in range(n))
    assert got["n"] == n and got["largest"] == pytest.approx((n - 1) * p + p0 - positives, rel=1e-3)
