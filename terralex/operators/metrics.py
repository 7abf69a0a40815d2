"""Scoring: regression metrics, per-station scores, ranking area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions.scalars import pearson
from terralex.operators.quantiles import value_ranks
from terralex.operators.temporal import daily_grain, needed_order


def _r2(truth: str, pred: str) -> Column:
    err = F.sum((F.col(truth) - F.col(pred)) * (F.col(truth) - F.col(pred)))
    spread = F.var_pop(truth) * F.count(truth)
    return F.when(spread > 0, 1.0 - err / spread)


def score_match(pred: DataFrame, truth: DataFrame, col: str, order: Sequence[str] | None = None) -> DataFrame:
    """Predictions with the truth of their station and day; no row or no value there is a miss.

    Of several rows of a station and day the first by ``order``, by default by ``date``, counts, also if it is
    the one without a value.
    """
    right = daily_grain(truth, needed_order(truth, order), [col]).select("station", "day", F.col(col).alias("truth"))
    return pred.join(right, ["station", "day"], "left").withColumn("matched", F.col("truth").isNotNull())


def regression_metrics(scored: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """R², RMSE, MAE, Pearson, counts and ranges in one aggregation; rows without truth are misses."""
    hit = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    t, p = F.when(hit, F.col(truth)), F.when(hit, F.col(pred))
    rows = scored.select(*by, t.alias("_t"), p.alias("_p"), hit.cast("int").alias("_h"))
    gap = F.col("_t") - F.col("_p")
    return rows.groupBy(*by).agg(
        _r2("_t", "_p").alias("r2"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        pearson("_t", "_p").alias("pearson"),
        F.sum("_h").alias("n_matched"),
        F.sum(1 - F.col("_h")).alias("n_missed"),
        F.avg("_t").alias("truth_mean"), F.min("_t").alias("truth_min"), F.max("_t").alias("truth_max"),
        F.avg("_p").alias("pred_mean"), F.min("_p").alias("pred_min"), F.max("_p").alias("pred_max"),
    )


def per_station_r2(scored: DataFrame, min_matches: int = 2) -> DataFrame:
    kept = scored.filter(F.col("truth").isNotNull())
    return (
        kept.groupBy("station")
        .agg(_r2("truth", "pred").alias("r2"), F.count("truth").alias("n"), F.avg("truth").alias("truth_mean"))
        .filter(F.col("n") >= min_matches)
    )


def worst_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).orderBy(F.col(score).asc(), F.col(tie).asc()).limit(k)


def top_k_by_score(df: DataFrame, score: Column, k: int, tie: str) -> DataFrame:
    return df.orderBy(score.desc_nulls_last(), F.col(tie).asc()).limit(k)


def competition_score(scored: DataFrame, by: str = "target") -> DataFrame:
    """Plain mean of the targets' R²."""
    each = regression_metrics(scored, by=[by])
    return each.agg(F.avg("r2").alias("score"), F.count("r2").alias("n_targets"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores share their average rank."""
    ranks = value_ranks(df, [], score).select(score, "rank")
    # One row per distinct score keeps a hot score from being a hot join key.
    tally = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias(score)).agg(
        F.sum(F.col(label).cast("int")).alias("_pos"), F.count(F.lit(1)).alias("_all")
    )
    total = tally.join(ranks, score).agg(
        F.sum(F.col("_pos") * F.col("rank")).alias("_r"), F.sum("_pos").alias("n_pos"),
        (F.sum("_all") - F.sum("_pos")).alias("n_neg"),
    )
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    area = (F.col("_r") - pos * (pos + 1) / 2.0) / (pos * neg)
    return total.select(F.when((pos > 0) & (neg > 0), area).alias("auc"), "n_pos", "n_neg")
