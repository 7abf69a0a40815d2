"""Registered queries: column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.functions import scalars as sc
from terralex.operators import tables as tb
from terralex.plans.q_temporal import r6
from terralex.plans.registry import query

EV = "CAST(ts AS DATE)"


def dated(t):
    return t.read("events").select("event_id", F.col("ts").cast("date").alias("day"))


@query(
    "calendar_features",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, CAST(dayofyear(o_orderdate) AS INT) AS day_of_year, CAST(year(o_orderdate) AS INT) AS year,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS month_cos,
  round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS doy_cos FROM orders""",
)
def calendar_features(t):
    out = sc.calendar_features(t.read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")
    return r6(out, "month_sin", "month_cos", "doy_sin", "doy_cos")


@query("year_fraction", "SELECT o_orderkey, round(year(o_orderdate) + dayofyear(o_orderdate) / 365.25, 6) AS year_frac FROM orders")
def year_fraction(t):
    return t.read("orders").select("o_orderkey", F.round(sc.year_fraction(F.col("o_orderdate")), 6).alias("year_frac"))


@query(
    "season_bucket",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM'
  WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season FROM orders""",
)
def season_bucket(t):
    return t.read("orders").select("o_orderkey", sc.season_bucket(F.col("o_orderdate")).alias("season"))


SQL_BANDS = """WITH b AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS green, abs(CAST(embedding[2] AS DOUBLE)) AS red,
  abs(CAST(embedding[3] AS DOUBLE)) AS nir, abs(CAST(embedding[4] AS DOUBLE)) AS swir16 FROM embeddings)
"""


def bands(t):
    names = ("green", "red", "nir", "swir16")
    e = t.read("embeddings")
    return e.select("vec_id", *[F.abs(F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate(names)])


@query(
    "normalized_difference",
    SQL_BANDS
    + """SELECT vec_id, round((nir - red) / (nir + red + 1e-8), 6) AS ndvi, round((green - nir) / (green + nir + 1e-8), 6) AS ndwi,
  round((nir - swir16) / (nir + swir16 + 1e-8), 6) AS ndmi, round((green - swir16) / (green + swir16 + 1e-8), 6) AS mndwi FROM b""",
)
def normalized_difference(t):
    out = sc.spectral_indices(bands(t)).select("vec_id", *sc.SPECTRAL_INDICES)
    return r6(out, *sc.SPECTRAL_INDICES)


@query(
    "band_ratios",
    SQL_BANDS
    + """SELECT vec_id, round(red / (green + 1e-8), 4) AS turbidity, round(nir / (red + 1e-8), 4) AS chlorophyll,
  round((swir16 + red - nir - green) / (swir16 + red + nir + green + 1e-8), 6) AS bare_soil FROM b""",
)
def band_ratios(t):
    out = sc.band_ratios(bands(t)).select("vec_id", "turbidity", "chlorophyll", "bare_soil")
    return r6(out.withColumns({c: F.round(c, 4) for c in ("turbidity", "chlorophyll")}), "bare_soil")


@query(
    "interaction_features",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS elevation, l_extendedprice AS dam_distance, l_discount AS slope, l_tax AS cropland,
  l_discount + l_tax AS urban, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS karst, l_quantity AS rain_7d, l_quantity * 3 + 1 AS rain_30d, l_tax * 2 AS tree, l_discount * 3 AS grass FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(elevation, 0)), 6) AS log_elevation, round(ln(1 + dam_distance), 6) AS log_dam_distance,
  round(elevation * slope, 4) AS elev_x_slope, round(elevation * rain_30d, 4) AS elev_x_rain, round(cropland * rain_30d, 4) AS crop_x_rain,
  round(urban * rain_30d, 4) AS urban_x_rain, round(karst * rain_30d, 4) AS karst_x_rain, round(rain_7d / (rain_30d + 1e-8), 6) AS rain_ratio,
  round((tree + grass) / (cropland + urban + 1e-8), 4) AS natural_ratio FROM l""",
)
def interaction_features(t):
    q, d, x = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    rows = t.read("lineitem").select(
        "l_orderkey", "l_linenumber", (q - 25).alias("elevation"), F.col("l_extendedprice").cast("double").alias("dam_distance"),
        d.alias("slope"), x.alias("cropland"), (d + x).alias("urban"), (F.col("l_linenumber") == 1).cast("int").alias("karst"),
        q.alias("rain_7d"), (q * 3 + 1).alias("rain_30d"), (x * 2).alias("tree"), (d * 3).alias("grass"),
    )
    out = sc.interaction_features(rows)
    six = ["log_elevation", "log_dam_distance", "rain_ratio"]
    four = ["elev_x_slope", "elev_x_rain", "crop_x_rain", "urban_x_rain", "karst_x_rain", "natural_ratio"]
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 4).alias(c) for c in four])


@query(
    "key_normalize",
    "SELECT sample_id, round_even(lat, 4) AS lat, round_even(lon, 4) AS lon, trim(CAST(day AS VARCHAR)) AS day FROM samples",
    ("samples",),
)
def key_normalize(t):
    return sc.key_normalize(t.samples(), ["lat", "lon", "day"]).select("sample_id", "lat", "lon", "day")


@query(
    "composite_key",
    """SELECT sample_id, concat_ws('_', CAST(round_even(lat * 1e4, 0) AS BIGINT), CAST(round_even(lon * 1e4, 0) AS BIGINT)) AS coord_key,
  concat_ws('|', CAST(sample_id AS VARCHAR), CAST(day AS VARCHAR)) AS text_key FROM samples""",
    ("samples",),
)
def composite_key(t):
    return t.samples().select(
        "sample_id", sc.coord_key(F.col("lat"), F.col("lon")).alias("coord_key"),
        sc.composite_key(F.col("sample_id"), F.col("day")).alias("text_key"),
    )


@query("unit_convert", "SELECT event_id, round(value * 10, 4) AS value, TRY_CAST(event_type AS DOUBLE) AS event_type FROM events")
def unit_convert(t):
    out = sc.unit_convert(t.read("events").select("event_id", "value", "event_type"), {"value": 10.0, "event_type": 1000.0})
    return out.withColumn("value", F.round("value", 4))


@query(
    "coverage_flags",
    """SELECT station, day, CASE WHEN coalesce(aux_1, aux_2) IS NOT NULL THEN 1 ELSE 0 END AS has_aux,
  CASE WHEN coalesce(target_a, target_b, target_c) IS NOT NULL THEN 1 ELSE 0 END AS has_target FROM observations""",
    ("observations",),
)
def coverage_flags(t):
    out = sc.coverage_flag(sc.coverage_flag(t.observations(), "aux_", "has_aux"), "target_", "has_target")
    return out.select("station", "day", "has_aux", "has_target")


@query("feature_select", "SELECT station, aux_1, aux_2 FROM observations", ("observations",))
def feature_select(t):
    obs = t.observations()
    return obs.select("station", *sc.select_features(obs, drop=["station"], prefixes=["aux_"]))


@query(
    "sanitize_numeric",
    """SELECT event_id, CASE WHEN value > 400 THEN 0e0 WHEN value < 1 THEN NULL ELSE value END AS kept,
  CASE WHEN value > 400 OR value < 1 THEN 0e0 ELSE value END AS filled, least(greatest(value - 50, 0e0), 200e0) AS clipped FROM events""",
)
def sanitize_numeric(t):
    v = F.col("value")
    raw = F.when(v > 400, F.lit(float("inf"))).when(v < 1, F.lit(float("nan"))).otherwise(v)
    rows = t.read("events").select("event_id", "value", raw.alias("raw"))
    return rows.select(
        "event_id", sc.sanitize(F.col("raw")).alias("kept"), sc.sanitize(F.col("raw"), True).alias("filled"),
        sc.clip_prediction(v - 50, F.lit(200.0)).alias("clipped"),
    )


@query(
    "target_transform",
    """SELECT event_id, round(ln(1 + greatest(value - 5, 0)), 8) AS log1p, round(ln(2 + greatest(value - 5, 0)), 8) AS shifted,
  round(greatest(value - 5, 0), 6) AS back, round(greatest(value - 5, 0), 6) AS back_shifted FROM events""",
)
def target_transform(t):
    rows = t.read("events").select("event_id", (F.col("value") - 5).alias("v"))
    l1, sh = sc.target_transform(F.col("v"), "log1p"), sc.target_transform(F.col("v"), "shifted_log")
    return rows.select(
        "event_id", F.round(l1, 8).alias("log1p"), F.round(sh, 8).alias("shifted"),
        F.round(sc.target_inverse(l1, "log1p"), 6).alias("back"), F.round(sc.target_inverse(sh, "shifted_log"), 6).alias("back_shifted"),
    )


@query(
    "yeo_johnson",
    """SELECT event_id, round(CASE WHEN value - 60 >= 0 THEN (pow(value - 59, 0.3e0) - 1) / 0.3e0 ELSE -(pow(61 - value, 1.7e0) - 1) / 1.7e0 END, 6) AS yj,
  round(value - 60, 5) AS back FROM events""",
)
def yeo_johnson(t):
    v = F.col("value") - 60
    yj = sc.yeo_johnson(v, 0.3)
    return t.read("events").select(
        "event_id", F.round(yj, 6).alias("yj"), F.round(sc.yeo_johnson_inverse(yj, 0.3), 5).alias("back")
    )


@query("yeo_johnson_fit")
def yeo_johnson_fit(t):
    from terralex.operators.learn import fit_yeo_johnson

    events = t.read("events")
    lam = fit_yeo_johnson(events, "value")
    return events.select("event_id", F.lit(lam).alias("lambda"), sc.yeo_johnson(F.col("value"), lam).alias("yj"))


@query(
    "category_map",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '  Limestone ' WHEN 1 THEN 'GRANITE' WHEN 2 THEN 'clay' WHEN 3 THEN 'moon dust' END AS lith FROM part)
SELECT p_partkey, CASE trim(lower(lith)) WHEN 'limestone' THEN 1 WHEN 'granite' THEN 3 WHEN 'clay' THEN 4 ELSE -1 END AS code,
  CASE WHEN trim(lower(lith)) = 'limestone' THEN 1 ELSE 0 END AS karst FROM n""",
)
def category_map(t):
    k = F.col("p_partkey") % 5
    lith = F.when(k == 0, "  Limestone ").when(k == 1, "GRANITE").when(k == 2, "clay").when(k == 3, "moon dust")
    code = sc.category_code(F.col("lith"))
    return t.read("part").select("p_partkey", lith.alias("lith")).select(
        "p_partkey", code.alias("code"), (code == 1).cast("int").alias("karst")
    )


@query(
    "nested_json_layers",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS soil_clay, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 / 10 AS soil_phh2o,
  CAST(NULL AS DOUBLE) AS soil_cec FROM events""",
)
def nested_json_layers(t):
    k = F.get_json_object("props", "$.k")
    depth = lambda x: F.concat(F.lit('"depths":[{"values":{"mean":'), x, F.lit('}},{"values":{"mean":-1}}]'))
    body = F.concat(
        F.lit('{"properties":{"layers":[{"name":"clay",'), depth(k), F.lit('},{"name":"phh2o",'),
        depth((k.cast("int") * 2).cast("string")), F.lit("}]}}"),
    )
    replies = t.read("events").select("event_id", body.alias("reply"))
    return tb.nested_json_layers(replies, "event_id", "reply", ["clay", "phh2o", "cec"])


@query(
    "standard_scale",
    """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice FROM orders""",
)
def standard_scale(t):
    return r6(tb.standard_scale(t.read("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), "o_totalprice")


@query(
    "polynomial_expand",
    """WITH s AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS a,
  (hour(ts) - avg(hour(ts)) OVER ()) / stddev_pop(hour(ts)) OVER () AS b FROM events)
SELECT event_id, round(a, 6) AS a, round(b, 6) AS b, round(a * a, 6) AS a_x_a, round(a * b, 6) AS a_x_b, round(b * b, 6) AS b_x_b FROM s""",
)
def polynomial_expand(t):
    rows = t.read("events").select("event_id", F.col("value").alias("a"), F.hour("ts").cast("double").alias("b"))
    return r6(tb.polynomial_expand(rows, ["a", "b"]), "a", "b", "a_x_a", "a_x_b", "b_x_b")


@query(
    "station_weights",
    "SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 4e0 ELSE 1e0 END AS weight FROM events",
)
def station_weights(t):
    test = t.read("customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("station"))
    rows = t.read("events").select("event_id", F.col("user_id").alias("station"))
    return tb.station_weights(rows, test).select("event_id", "weight")
