"""Adjusting predictions with station statistics and blending methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.operators.quantiles import exact_quantiles, global_row


def station_calibrate(pred: DataFrame, stats: DataFrame, pooled: DataFrame, blend: float = 0.5) -> DataFrame:
    """Map a prediction's global z-score onto its station's distribution and blend half and half.

    The mapped value is clipped to half the station's minimum and 1.5 times its maximum. Stations
    without statistics keep the prediction; results are not negative.
    """
    g = F.col("_g")
    joined = pred.join(stats.select("station", *[F.col(c).alias(f"_{c}") for c in ("mean", "std", "min", "max")]), "station", "left")
    joined = joined.withColumn("_g", global_row(pooled))
    spread = F.when(F.col("_std") < 1e-8, g["global_std"]).otherwise(F.col("_std"))
    mapped = F.col("_mean") + (F.col("pred") - g["global_mean"]) / g["global_std"] * spread
    low, high = F.col("_min") * 0.5, F.col("_max") * 1.5
    clipped = F.when(mapped < low, low).when(mapped > high, high).otherwise(mapped)
    out = F.when(F.col("_mean").isNull(), F.col("pred")).otherwise((1 - blend) * F.col("pred") + blend * clipped)
    return joined.withColumn("calibrated", F.greatest(out, F.lit(0.0))).select(*pred.columns, "calibrated")


def variance_decompress(pred: DataFrame, stats: DataFrame, pooled: DataFrame, cap: float = 2.0) -> DataFrame:
    """Stretch a station's predictions to the station's observed spread, by at most ``cap``."""
    own = pred.groupBy("station").agg(F.avg("pred").alias("_pm"), F.stddev_pop("pred").alias("_ps"))
    facts = own.join(stats.select("station", F.col("mean").alias("_mean"), F.col("std").alias("_std")), "station")
    g = F.col("_g")
    joined = pred.join(facts, "station", "left").withColumn("_g", global_row(pooled))
    spread = F.when(F.col("_std") < 1e-8, g["global_std"]).otherwise(F.col("_std"))
    factor = F.least(spread / F.greatest(F.col("_ps"), F.lit(1e-8)), F.lit(cap))
    moved = F.col("_mean") + (F.col("pred") - F.col("_pm")) * factor
    out = F.coalesce(moved, F.col("pred"))
    return joined.withColumn("decompressed", F.greatest(out, F.lit(0.0))).select(*pred.columns, "decompressed")


# Target kind -> (share of decompression, largest share of the station's prediction).
BLEND_LIMITS = {"conductance": (0.35, 0.35), "alkalinity": (0.30, 0.25), "phosphorus": (0.15, 0.15)}


def confidence_blend(base: Column, decompressed: Column, station_pred: Column, conf: Column, kind: str) -> Column:
    """Mostly the global prediction, corrected where the station's own one is confident and close."""
    beta, limit = BLEND_LIMITS[kind]
    adjusted = base + beta * (decompressed - base)
    trust = F.greatest(F.least((conf - 0.8) * 1.5, F.lit(limit)), F.lit(0.0))
    ratio = station_pred / (adjusted + 1e-6)
    trust = F.when((ratio < 0.6) | (ratio > 1.6), trust * 0.35).otherwise(trust)
    usable = station_pred.isNotNull() & ~F.isnan(station_pred) & (F.abs(station_pred) < float("inf")) & (station_pred > 0)
    mixed = F.when(usable, trust * station_pred + (1.0 - trust) * adjusted).otherwise(adjusted)
    return F.greatest(mixed, F.lit(0.0))


def method_blend(
    samples: DataFrame, methods: Sequence[tuple[str, str, float]], obs: DataFrame, col: str
) -> DataFrame:
    """Confidence-weighted mean of (prediction, confidence, factor) columns; fallbacks below.

    All confidences zero: plain mean, confidence 0.1. No prediction: the station's median, 0.2; then
    0. The confidence is the mean of the used ones.
    """
    cands = F.filter(
        F.array(*[F.struct(F.col(p).cast("double").alias("p"), (F.col(c) * f).alias("c")) for p, c, f in methods]),
        lambda x: x["p"].isNotNull(),
    )
    fold = lambda f: F.aggregate("_c", F.lit(0.0), lambda s, x: s + f(x))
    n = F.size("_c")
    total = fold(lambda x: x["c"])
    weighted = F.when(total > 0, fold(lambda x: x["p"] * x["c"]) / F.when(total > 0, total))
    plain = F.when(n > 0, fold(lambda x: x["p"]) / F.when(n > 0, n))
    med = exact_quantiles(obs, ["station"], col, [0.5], ["_median"])
    joined = samples.withColumn("_c", cands).join(med, "station", "left")
    pred = F.coalesce(weighted, plain, F.col("_median"))
    conf = (
        F.when((n > 0) & (total > 0), total / F.when(n > 0, n)).when(n > 0, 0.1)
        .when(F.col("_median").isNotNull(), 0.2).otherwise(0.0)
    )
    out = joined.withColumns({"blend": pred, "blend_conf": conf})
    return out.withColumn("blend", F.greatest(F.coalesce("blend", F.lit(0.0)), F.lit(0.0))).drop("_c", "_median")
