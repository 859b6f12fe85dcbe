import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerloom.operators import ranking


def frame(spark, scores, labels):
    return spark.createDataFrame([(f"{i:05d}", y, float(s)) for i, (s, y) in enumerate(zip(scores, labels))], "id string, label int, score double")


def test_golden_top_three(spark):
    got = rows(ranking.top_k(frame(spark, [.9, .8, .5, .5, .5, .5, .1], [1, 0, 1, 0, 1, 0, 0]), 3))[0]
    assert (got["expected_hits"], got["min_hits"], got["max_hits"], got["tie_block"], got["deterministic_hits"]) == (1.5, 1, 2, 4, 2)


def test_constant_score(spark):
    got = rows(ranking.top_k(frame(spark, [.5] * 10, [1, 1] + [0] * 8), 5))[0]
    assert (got["expected_hits"], got["tie_block"], got["min_hits"], got["max_hits"]) == (1.0, 10, 0, 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 200
    scores = [rng.randrange(12) / 10 for _ in range(n)]
    labels = [int(rng.random() < 0.3) for _ in range(n)]
    got = rows(ranking.evaluate(frame(spark, scores, labels)))[0]
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted(set(scores), reverse=True):
        above = [y for t, y in zip(scores, labels) if t >= s]
        ap += sum(y for t, y in zip(scores, labels) if t == s) / len(pos) * sum(above) / len(above)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    assert got["auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)
    assert got["top_deterministic_hits"] == sum(labels[i] for i in order[:20])
    assert got["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in zip(scores, labels)) / n)
    assert got["top_min_hits"] <= got["top_deterministic_hits"] <= got["top_max_hits"]


def test_single_class_has_no_area(spark):
    got = rows(ranking.evaluate(frame(spark, [.1, .2, .3], [0, 0, 0])))[0]
    assert got["auc"] is None and got["pr_auc"] is None and got["n"] == 3 and got["positives"] == 0


def test_order_of_input_does_not_matter(spark):
    scores, labels = [.5, .5, .7, .2, .5], [1, 0, 1, 0, 1]
    a = frame(spark, scores, labels)
    b = a.orderBy(F.desc("id")).repartition(3)
    assert rows(ranking.evaluate(a))[0] == pytest.approx(rows(ranking.evaluate(b))[0])


def test_k_beyond_and_below_the_rows(spark):
    df = frame(spark, [.3, .2], [1, 0])
    assert rows(ranking.top_k(df, 99))[0]["k"] == 2
    assert rows(ranking.top_k(df, 0))[0]["expected_hits"] is None
    assert rows(ranking.top_k(df.limit(0), 3))[0]["n"] == 0


def test_gains_rise_to_one(spark):
    df = frame(spark, [i / 20 for i in range(20)], [i % 2 for i in range(20)])
    curve = rows(ranking.gains(ranking.score_steps(df)), "step")
    assert len(curve) == 11 and curve[0]["captured"] == 0 and curve[-1]["captured"] == pytest.approx(1.0)
    assert [r["k"] for r in curve[1:3]] == [2, 4] and curve[1]["captured"] == pytest.approx(0.1)


def test_lift_uses_the_expected_hits(spark):
    got = rows(ranking.lift_at(frame(spark, [.5] * 10, [1, 1] + [0] * 8), 0.5))[0]
    assert got["lift"] == pytest.approx(1.0) and got["k"] == 5
