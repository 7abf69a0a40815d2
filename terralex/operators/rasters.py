"""Reductions of pixel tables and daily weather around samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.functions.scalars import normalized_difference
from terralex.operators.quantiles import exact_quantiles


def composite_median(pixels: DataFrame, samples: DataFrame, bands: Sequence[str], lookback_days: int = 60) -> DataFrame:
    """Per sample and band: median over the lookback's dates per pixel, then over pixels; and indices.

    ``pixels`` is (loc_id, day, band, y, x, value), ``samples`` (loc_id, day). Scenes are joined per
    distinct (location, day), by periods as long as the lookback: an ask meets the two it reaches into.
    """
    asked = samples.select("loc_id", F.col("day").alias("asked")).distinct()
    period = lambda d: F.floor(F.unix_date(d) / F.lit(lookback_days + 1))
    reach = F.sequence(period(F.date_sub("asked", lookback_days)), period(F.col("asked")))
    inside = (F.col("day") <= F.col("asked")) & (F.col("day") >= F.date_sub("asked", lookback_days))
    scenes = pixels.filter(F.col("band").isin(*bands)).withColumn("_period", period(F.col("day")))
    seen = asked.withColumn("_period", F.explode(reach)).join(scenes, ["loc_id", "_period"]).filter(inside).drop("_period")
    per_pixel = exact_quantiles(seen, ["loc_id", "asked", "band", "y", "x"], "value", [0.5], ["m"])
    per_band = exact_quantiles(per_pixel, ["loc_id", "asked", "band"], "m", [0.5], ["m"])
    wide = per_band.groupBy("loc_id", F.col("asked").alias("day")).agg(
        *[F.max(F.when(F.col("band") == b, F.col("m"))).alias(b) for b in bands]
    )
    # Index -> bands, as named by the imagery.
    indices = {"ndmi": ("nir08", "swir16"), "mndwi": ("green", "swir16"), "ndvi": ("nir08", "red")}
    extra = {n: normalized_difference(F.col(a), F.col(b)) for n, (a, b) in indices.items() if a in bands and b in bands}
    return wide.withColumns(extra)


# Land-cover class -> name.
LAND_COVER = {
    10: "tree_cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built_up", 60: "bare_sparse",
    70: "snow_ice", 80: "water", 90: "herbaceous_wetland", 95: "mangroves", 100: "moss_lichen",
}


def class_fractions(pixels: DataFrame, classes: Mapping[int, str] = LAND_COVER, prefix: str = "lc_") -> DataFrame:
    """Share of each class among all pixels of a location and how many classes occur."""
    share = {n: F.avg(F.when(F.col("value") == k, 1.0).otherwise(0.0)) for k, n in classes.items()}
    found = pixels.groupBy("loc_id").agg(*[v.alias(f"{prefix}{n}") for n, v in share.items()])
    present = sum(((F.col(f"{prefix}{n}") > 0).cast("int") for n in list(classes.values())[1:]),
                  (F.col(f"{prefix}{next(iter(classes.values()))}") > 0).cast("int"))
    return found.withColumn(f"{prefix}diversity", present)


def positive_pixel_stats(pixels: DataFrame) -> DataFrame:
    """Mean and maximum over positive pixels (0 if there are none) and their share."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    return pixels.groupBy("loc_id").agg(
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("positive_mean"),
        F.coalesce(F.max(positive), F.lit(0.0)).alias("positive_max"),
        (F.count(positive) / F.count(F.lit(1))).alias("positive_share"),
    )


CELL_DEGREES = 0.00027777777
METRES_PER_DEGREE = 111132.0


def terrain_stats(dem: DataFrame, locations: DataFrame) -> DataFrame:
    """Elevation, slope and aspect summaries from a height grid.

    Gradients are central differences, one-sided at the edges. A window holds one raster line.
    """
    def gradient(line: str, along: str) -> F.Column:
        w = Window.partitionBy("loc_id", line).orderBy(along)
        before, after, here = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        return (
            F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2.0)
            .when(after.isNotNull(), after - here)
            .when(before.isNotNull(), here - before)
        )

    grid = dem.withColumn("gx", gradient("y", "x")).withColumn("gy", gradient("x", "y"))
    north = F.lit(CELL_DEGREES * METRES_PER_DEGREE)
    east = north * F.cos(F.radians("lat"))
    placed = grid.join(locations.select("loc_id", "lat"), "loc_id")
    rise_x, rise_y = F.col("gx") / east, F.col("gy") / north
    placed = placed.withColumn("slope", F.sqrt(rise_x * rise_x + rise_y * rise_y)).withColumn(
        "aspect", F.atan2(F.col("gy"), -F.col("gx"))
    )
    return placed.groupBy("loc_id").agg(
        F.avg("value").alias("elevation_mean"), F.stddev_pop("value").alias("elevation_std"),
        F.avg("slope").alias("slope_mean"), F.max("slope").alias("slope_max"), F.stddev_pop("slope").alias("slope_std"),
        F.avg("aspect").alias("aspect_mean"), (F.max("value") - F.min("value")).alias("valley_depth"),
    )


def weather_trailing(samples: DataFrame, daily: DataFrame, sums: Sequence[str] = ("rain", "et"), means: Sequence[str] = ()) -> DataFrame:
    """Sums over the last 7 daily rows and over all rows of the 31 days ending at the sample's day.

    An empty sum is 0; samples without any row there have nulls. The balance is rain minus et.
    """
    from terralex.operators.temporal import asof_payload, recent_arrays, sample_days

    days = daily.withColumnRenamed("loc_id", "station")
    item = F.struct("day", *[F.col(c).cast("double").alias(c) for c in (*sums, *means)])
    asked = samples.withColumnRenamed("loc_id", "station")
    found = asof_payload(sample_days(asked), recent_arrays(days, item, 31, True), F.col("items"), "_w", "upto")
    kept = F.filter("_w", lambda x: x["day"] >= F.date_sub(F.col("day"), 30))
    found = found.withColumn("_w", F.when(F.size(kept) > 0, kept))
    total = lambda arr, c: F.aggregate(arr, F.lit(0.0), lambda s, x: s + F.coalesce(x[c], F.lit(0.0)))
    last7 = F.slice("_w", F.greatest(F.size("_w") - 6, F.lit(1)), 7)
    some = F.col("_w").isNotNull()
    out = {}
    for c in sums:
        out[f"{c}_7d"] = F.when(some, total(last7, c))
        out[f"{c}_30d"] = F.when(some, total(F.col("_w"), c))
    from terralex.functions.vectors import mean_of

    for c in means:
        out[f"{c}_30d_mean"] = F.when(some, mean_of(F.transform("_w", lambda x: x[c])))
    found = found.withColumns(out)
    if {"rain", "et"} <= set(sums):
        found = found.withColumn("water_balance_30d", F.col("rain_30d") - F.col("et_30d"))
    return asked.join(found.drop("_w"), ["station", "day"], "left").withColumnRenamed("station", "loc_id")
