"""Per-station summaries. Long form: one row per station and column."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions.scalars import pearson
from terralex.operators.quantiles import exact_quantiles, global_row, melt

DAYS_PER_YEAR = 365.25
TINY = 1e-8


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def history_until(obs: DataFrame, cutoff: str) -> DataFrame:
    """A station's rows up to the cutoff, or all its rows when fewer than three lie before it."""
    early = F.col("day") <= _day(cutoff)
    enough = obs.groupBy("station").agg(F.sum(early.cast("int")).alias("_n"))
    return obs.join(enough, "station").filter(early | (F.col("_n") < 3)).drop("_n")


def _values(obs: DataFrame, cols: Sequence[str]) -> DataFrame:
    return melt(obs, ["station", "day"], cols).filter(F.col("value").isNotNull())


def station_profile(obs: DataFrame, cols: Sequence[str], cutoff: str) -> DataFrame:
    """Mean, median, spread (population), IQR, cv, p10, p90, count; under 3 values only the mean."""
    values = _values(history_until(obs, cutoff), cols)
    base = values.groupBy("station", "col").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n")
    )
    q = exact_quantiles(values, ["station", "col"], "value", [0.1, 0.25, 0.5, 0.75, 0.9], ["p10", "q25", "median", "q75", "p90"])
    full = F.col("n") >= 3
    when = lambda c, name: F.when(full, c).alias(name)
    return base.join(q, ["station", "col"]).select(
        "station", "col", "mean",
        when(F.col("median"), "median"), when(F.col("std"), "std"),
        when(F.col("q75") - F.col("q25"), "iqr"), when(F.col("std") / (F.col("mean") + TINY), "cv"),
        when(F.col("p10"), "p10"), when(F.col("p90"), "p90"), when(F.col("n"), "count"),
    )


def seasonal_harmonic(obs: DataFrame, cols: Sequence[str], cutoff: str) -> DataFrame:
    """Amplitude and phase of the yearly cycle of monthly means; an empty month takes the overall mean."""
    values = _values(history_until(obs, cutoff), cols)
    month = F.month("day")
    grouped = values.groupBy("station", "col").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.array(*[F.avg(F.when(month == m, F.col("value"))) for m in range(1, 13)]).alias("_m"),
    )
    filled = grouped.withColumn("_f", F.transform("_m", lambda x: F.coalesce(x, F.col("mean"))))
    centred = filled.withColumn("_c", F.transform("_f", lambda x: x - _total(F.col("_f")) / 12.0))
    wave = lambda fn: F.array(*[F.lit(fn(2 * math.pi * i / 12)) for i in range(12)])
    project = lambda fn: _total(F.zip_with("_c", wave(fn), lambda x, y: x * y)) / 6.0
    out = centred.withColumns({"_cos": project(math.cos), "_sin": project(math.sin)})
    full = F.col("n") >= 3
    return out.select(
        "station", "col",
        F.when(full, F.sqrt(F.col("_cos") ** 2 + F.col("_sin") ** 2)).alias("season_amp"),
        F.when(full, F.atan2("_sin", "_cos")).alias("season_phase"),
    )


def trend_slope(obs: DataFrame, cols: Sequence[str], cutoff: str, min_values: int = 10) -> DataFrame:
    """Least-squares slope per year; 0 below the minimum number of values."""
    values = _values(history_until(obs, cutoff), cols)
    years = F.datediff("day", _day("2000-01-01")) / F.lit(DAYS_PER_YEAR)
    slope = F.regr_slope("value", years)
    return values.groupBy("station", "col").agg(
        F.when(F.count("value") >= min_values, F.coalesce(slope, F.lit(0.0))).otherwise(0.0).alias("trend")
    )


def recent_window_stats(obs: DataFrame, cols: Sequence[str], cutoff: str, years: Sequence[int] = (2, 5)) -> DataFrame:
    """Mean and population spread over the last years before the cutoff; the overall ones below 2 values."""
    values = _values(history_until(obs, cutoff), cols)
    n = F.count("value")
    aggs = [F.avg("value").alias("_mean"), F.when(n >= 3, F.stddev_pop("value")).alias("_std")]
    for y in years:
        inside = (F.col("day") >= F.add_months(_day(cutoff), -12 * y)) & (F.col("day") <= _day(cutoff))
        v = F.when(inside, F.col("value"))
        aggs += [F.count(v).alias(f"_n{y}"), F.avg(v).alias(f"_m{y}"), F.stddev_pop(v).alias(f"_s{y}")]
    out = values.groupBy("station", "col").agg(*aggs)
    pick = lambda y, own, base: F.when(F.col(f"_n{y}") >= 2, F.col(own)).otherwise(F.col(base))
    return out.select(
        "station", "col",
        *[c for y in years for c in (pick(y, f"_m{y}", "_mean").alias(f"recent_{y}y_mean"), pick(y, f"_s{y}", "_std").alias(f"recent_{y}y_std"))],
    )


def pairwise_corr(obs: DataFrame, cols: Sequence[str], cutoff: str, min_pairs: int = 10) -> DataFrame:
    """Pearson correlation of each pair of columns per station over complete rows; 0 if too few, NaN if a column is constant there."""
    hist = history_until(obs, cutoff)
    aggs = []
    for a, b in itertools.combinations(cols, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.when(F.sum(both.cast("int")) >= min_pairs, pearson(a, b)).otherwise(0.0).alias(f"corr_{a}_{b}"))
    return hist.groupBy("station").agg(*aggs)


def station_aux_stats(obs: DataFrame, cols: Sequence[str], cutoff: str | None = None) -> DataFrame:
    """Mean, sample spread, median, cv and range of monthly means per column; under 3 values the mean.

    With the station's number of rows and span in years. ``cutoff`` keeps later rows out.
    """
    used = obs.filter(F.col("day") <= _day(cutoff)) if cutoff else obs
    values = _values(used, cols)
    month = F.month("day")
    grouped = values.groupBy("station", "col").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.array(*[F.avg(F.when(month == m, F.col("value"))) for m in range(1, 13)]).alias("_m"),
    )
    med = exact_quantiles(values, ["station", "col"], "value", [0.5], ["median"])
    span = used.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_obs"),
        (F.datediff(F.max("day"), F.min("day")) / F.lit(DAYS_PER_YEAR)).alias("span_years"),
    )
    full = F.col("n") >= 3
    season = F.array_max("_m") - F.array_min("_m")
    return grouped.join(med, ["station", "col"]).join(span, "station").select(
        "station", "col", "mean",
        F.when(full, F.col("std")).alias("std"), F.when(full, F.col("median")).alias("median"),
        F.when(full, F.col("std") / (F.col("mean") + TINY)).alias("cv"), F.when(full, season).alias("season_range"),
        "n_obs", "span_years",
    )


def widen(profile: DataFrame, cols: Sequence[str], stats: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per station with ``<col>_<stat>`` columns, for joining onto samples."""
    picks = [F.max(F.when(F.col("col") == c, F.col(s))).alias(f"{c}_{s}") for c in cols for s in stats]
    return profile.groupBy("station", *keep).agg(*picks)


def decay_weighted_stats(obs: DataFrame, cols: Sequence[str], halflife_days: float = 730.0) -> DataFrame:
    """Mean and spread with weights halving every half-life before the station's last day.

    The trend is the weighted minus the plain mean. Needs three rows and three values.
    """
    last = obs.groupBy("station").agg(F.max("day").alias("_last"), F.count(F.lit(1)).alias("_rows")).filter("_rows >= 3")
    age = F.datediff("_last", "day")
    values = _values(obs, cols).join(last, "station").withColumn("w", F.exp(F.lit(-math.log(2) / halflife_days) * age))
    first = values.groupBy("station", "col").agg(
        (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("tw_mean"),
        F.avg("value").alias("_plain"), F.sum("w").alias("_w"), F.count("value").alias("_n"),
    ).filter("_n >= 3 AND _w >= 1e-10")
    # A second pass around the mean keeps the spread accurate.
    off = F.col("value") - F.col("tw_mean")
    second = values.join(first, ["station", "col"]).groupBy("station", "col").agg(
        F.sqrt(F.sum(F.col("w") * off * off) / F.sum("w")).alias("tw_std")
    )
    return first.join(second, ["station", "col"]).select(
        "station", "col", "tw_mean", "tw_std", (F.col("tw_mean") - F.col("_plain")).alias("tw_trend")
    )


def station_stats(obs: DataFrame, col: str, exclude: DataFrame | None = None, min_values: int = 5) -> DataFrame:
    """Distribution of a column per station with enough values, excluded station-days left out."""
    used = obs.join(exclude, ["station", "day"], "left_anti") if exclude is not None else obs
    values = used.filter(F.col(col).isNotNull()).select("station", F.col(col).alias("value"))
    base = values.groupBy("station").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"),
    ).filter(F.col("n") >= min_values)
    q = exact_quantiles(values, ["station"], "value", [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    return base.join(q, "station")


def pooled_stats(obs: DataFrame, col: str, stats: DataFrame) -> DataFrame:
    """Mean and population spread over all values of the stations in ``stats``; spread under 1e-8 is 1."""
    kept = obs.join(stats.select("station"), "station", "left_semi")
    std = F.stddev_pop(col)
    return kept.agg(F.avg(col).alias("global_mean"), F.when(std < TINY, 1.0).otherwise(std).alias("global_std"))


def winsorize(df: DataFrame, col: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the exact low and high quantiles."""
    q = F.col("_q")
    bounds = global_row(exact_quantiles(df, [], col, [low, high], ["lo", "hi"]))
    clipped = F.when(F.col(col) < q["lo"], q["lo"]).when(F.col(col) > q["hi"], q["hi"]).otherwise(F.col(col))
    return df.withColumn("_q", bounds).withColumn(col, clipped).drop("_q")
