"""Quality of a score ordering, with tied scores treated explicitly.

Everything reads one frame of distinct scores: (score, n, pos, n_upto, pos_upto), best score first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .order_stats import rows_at, running_sums


def score_steps(df: DataFrame, label: str = "label", score: str = "score", parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores in descending order with row and positive counts, own and cumulative; for each key of ``by`` apart."""
    steps = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return running_sums(steps, [F.desc("score")], ["n", "pos"], parts, by)


def summary(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each key of ``by``) from one pass over the distinct scores: sizes, Brier score, ROC AUC (ties count half) and
    average precision (step sum). The areas are NULL when only one class exists.

    A positive beats the negatives that no better or equal score holds, and half of those it ties with.
    """
    s, n, pos = F.col("score"), F.col("n"), F.col("pos")
    not_beaten = (F.col("n_upto") - F.col("pos_upto")).cast("double") - (n - pos) / 2
    sums = steps.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.count("*").alias("distinct_scores"), F.sum(n * s).alias("score_sum"),
        F.sum(pos * (1 - s) * (1 - s) + (n - pos) * s * s).alias("squares"),
        F.sum(pos * not_beaten).alias("not_beaten"), F.sum(pos * (F.col("pos_upto") / F.col("n_upto"))).alias("precision_sum"))
    positives, negatives = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    two_classes = (positives > 0) & (negatives > 0)
    return sums.select(
        *by, "n", "positives", F.try_divide(positives, F.col("n")).alias("prevalence"), F.try_divide("score_sum", "n").alias("mean_score"),
        F.try_divide("squares", "n").alias("brier"), "distinct_scores",
        F.when(two_classes, 1 - F.try_divide(F.col("not_beaten"), positives * negatives)).alias("auc"),
        F.when(two_classes, F.try_divide(F.col("precision_sum"), positives)).alias("pr_auc"))


def score_summary(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Size, prevalence, Brier score, distinct scores and areas of one scored table."""
    return summary(score_steps(df, label, score))


def _cut_fields(k: Column) -> list[Column]:
    """Hits among the first ``k`` rows, from the step that holds row ``k``."""
    block, block_pos = F.col("n"), F.col("pos")
    above, above_pos = F.col("n_upto") - block, F.col("pos_upto") - block_pos
    slots = k - above
    return [
        k.alias("k"), F.col("score").alias("cut_score"), above.alias("strictly_above"),
        block.alias("tie_block"), block_pos.alias("tie_block_positives"), slots.alias("slots"), above_pos.alias("positives_above"),
        (above_pos + block_pos * slots / block).alias("expected_hits"),
        (above_pos + F.greatest(F.lit(0), slots - (block - block_pos))).alias("min_hits"),
        (above_pos + F.least(block_pos, slots)).alias("max_hits"),
    ]


def hits_at(steps: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per k (between 1 and the number of rows; for each key of ``by`` apart): expected hits over all orders of the
    tied block at the cut, and the least and most any order could give."""
    candidates = F.array(*[F.lit(k).cast("long") for k in sorted(set(ks))])
    held = F.filter(candidates, lambda k: (k > F.col("n_upto") - F.col("n")) & (k <= F.col("n_upto")))
    return steps.select("*", F.explode(held).alias("_k")).select(*by, *_cut_fields(F.col("_k")))


def share_to_k(n: int, share: float) -> int:
    return max(1, int(n * share))


def top_k(
    df: DataFrame, k: int, id_col: str = "id", label: str = "label", score: str = "score",
    steps: DataFrame | None = None, total: int | None = None,
) -> DataFrame:
    """Tie-aware hits at ``k`` plus ``deterministic_hits``, the hits when ties go to the lowest id.

    Ids must be unique; ids that repeat so that more than ``k`` rows would be taken are an error.
    The tied block is never sorted in one task: the id that closes the k-th place is found by rank, and
    hits are then one aggregate over the rows that score above the cut or tie up to that id.
    """
    steps = steps if steps is not None else score_steps(df, label, score)
    spark = df.sparkSession
    if total is None:
        total = steps.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total == 0 or k <= 0:
        return spark.createDataFrame([(k, total)], "k bigint, n bigint").withColumns({
            c: F.lit(None).cast("bigint") for c in ("deterministic_hits", "min_hits", "max_hits", "tie_block", "tie_block_positives", "strictly_above")
        }).withColumn("expected_hits", F.lit(None).cast("double"))
    cut = hits_at(steps, [min(k, total)])
    at = cut.first()
    tied = F.col(score).cast("double") == F.lit(at["cut_score"])
    if at["slots"] == at["tie_block"]:
        taken = tied
    else:
        last = rows_at(df.where(tied).select(id_col), [(id_col, True)], [at["slots"]])[0]
        taken = tied & (F.col(id_col) <= F.lit(last[id_col]))
    chosen = df.where((F.col(score).cast("double") > F.lit(at["cut_score"])) | taken)
    repeated = F.raise_error(F.lit(f"{id_col} repeats among the rows that tie at the cut")).cast("long")
    hits = chosen.agg(F.when(F.count("*") == min(k, total), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).otherwise(repeated)).scalar()
    return cut.select("k", F.lit(total).cast("long").alias("n"), hits.alias("deterministic_hits"), "expected_hits",
                      "min_hits", "max_hits", "tie_block", "tie_block_positives", "strictly_above")


def gains(steps: DataFrame, shares: int = 10) -> DataFrame:
    """Share of all positives expected in the best 1/shares, 2/shares, .. of the rows."""
    totals = steps.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    n, positives = totals["n"] or 0, totals["pos"] or 0
    spark = steps.sparkSession
    origin = spark.createDataFrame([(0, 0, 0.0, 0.0)], "step int, k bigint, expected_hits double, captured double")
    if n == 0:
        return origin
    points = spark.createDataFrame([(i, max(1, n * i // shares)) for i in range(1, shares + 1)], "step int, k bigint")
    held = hits_at(steps, [max(1, n * i // shares) for i in range(1, shares + 1)]).select("k", "expected_hits")
    captured = F.col("expected_hits") / positives if positives else F.lit(0.0)
    # Both sides have at most ``shares`` rows.
    curve = points.join(F.broadcast(held), "k").select("step", "k", "expected_hits", captured.alias("captured"))
    return origin.unionByName(curve).withColumn("share", F.col("step") / shares)


def lift_at(df: DataFrame, share: float = 0.1, label: str = "label", score: str = "score", steps: DataFrame | None = None) -> DataFrame:
    """Expected hit rate of the best ``share`` of rows against the base rate; NULLs for a table without rows."""
    steps = steps if steps is not None else score_steps(df, label, score)
    totals = steps.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    if not totals["n"]:
        return df.sparkSession.createDataFrame([(None,) * 4], "k bigint, top_rate double, base_rate double, lift double")
    k = share_to_k(totals["n"], share)
    base = totals["pos"] / totals["n"]
    return hits_at(steps, [k]).select(
        "k", (F.col("expected_hits") / F.col("k")).alias("top_rate"), F.lit(base).alias("base_rate"),
        F.try_divide(F.col("expected_hits") / F.col("k"), F.lit(base)).alias("lift"))


def evaluate(df: DataFrame, id_col: str = "id", label: str = "label", score: str = "score", share: float = 0.1) -> DataFrame:
    """One row: size, prevalence, AUC, average precision, Brier score and hits among the best ``share``."""
    return _evaluated(df, [score], id_col, label, share).drop("model")


def evaluate_scores(df: DataFrame, score_cols: Sequence[str], id_col: str, label: str, share: float = 0.1) -> DataFrame:
    """``evaluate`` for several stored score columns of one table, whose ids must be unique."""
    repeats = df.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(F.count("*")).first()[0]
    if repeats:
        raise ValueError(f"{repeats} value(s) of {id_col} repeat")
    return _evaluated(df, score_cols, id_col, label, share)


def _evaluated(df: DataFrame, score_cols: Sequence[str], id_col: str, label: str, share: float) -> DataFrame:
    """All models from one sort and one write of their distinct scores, keyed by model.

    The cuts are read from the written steps. Where a tied block is cut, the id that closes it is selected by rank, and the
    hits of all models are one last aggregate over the rows.
    """
    spark = df.sparkSession
    models = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in score_cols]))
    tall = df.select(F.col(label).alias("label"), models.alias("m")).select("label", "m.*")
    steps = score_steps(tall, by=["model"])
    whole, _ = stage(summary(steps, ["model"]), "summaries")  # one row for each model
    total = max((r["n"] for r in whole.collect()), default=0)
    if not total:
        empty = summary(steps.limit(0)).select(*[F.lit(c).alias(f"m{i}") for i, c in enumerate(score_cols)], "*")
        nothing = {"top_k": "bigint", "top_deterministic_hits": "bigint", "top_expected_hits": "double", "top_min_hits": "bigint", "top_max_hits": "bigint",
                   "top_tie_block": "bigint", "top_tie_block_positives": "bigint", "top_strictly_above": "bigint", "random_expected_hits": "double"}
        named = empty.select(F.explode(F.array(*[f"m{i}" for i in range(len(score_cols))])).alias("model"), *[c for c in empty.columns if not c[1:].isdigit()])
        return named.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    k = share_to_k(total, share)
    cuts = {r["model"]: r for r in hits_at(steps, [k], ["model"]).collect()}  # one row for each model
    hits = []
    for name, at in cuts.items():
        score = F.col(name).cast("double")
        tied = score.eqNullSafe(F.lit(at["cut_score"]).cast("double"))
        taken = tied
        if at["slots"] != at["tie_block"]:
            last = rows_at(df.where(tied).select(id_col), [(id_col, True)], [at["slots"]])[0]
            taken = tied & (F.col(id_col) <= F.lit(last[id_col]))
        chosen = F.coalesce(score > F.lit(at["cut_score"]), F.lit(False)) | taken
        repeated = F.raise_error(F.lit(f"{id_col} repeats among the rows that tie at the cut")).cast("long")
        hits.append(F.when(F.count_if(chosen) == k, F.coalesce(F.sum(F.when(chosen, F.col(label).cast("long"))), F.lit(0))).otherwise(repeated).alias(name))
    found = df.agg(*hits).first()
    fields = ("expected_hits", "min_hits", "max_hits", "tie_block", "tie_block_positives", "strictly_above")
    rows = [(name, k, found[name], *[at[f] for f in fields]) for name, at in cuts.items()]
    top = spark.createDataFrame(rows, "model string, top_k bigint, top_deterministic_hits bigint, top_expected_hits double, top_min_hits bigint, "
                                "top_max_hits bigint, top_tie_block bigint, top_tie_block_positives bigint, top_strictly_above bigint")
    return whole.join(F.broadcast(top), "model").withColumn("random_expected_hits", F.col("prevalence") * F.col("top_k"))  # one row for each model
