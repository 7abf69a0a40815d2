"""Registered queries: sources, keyed joins, set steps and raster reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.operators import rasters as ra
from terralex.operators import tables as tb
from terralex.plans.q_temporal import r6
from terralex.plans.registry import query
from terralex.session import scratch_folder
from terralex.sources import observations as ob
from terralex.sources import pages as pg
from terralex.sources.spread import spread


@query(
    "load_observations",
    """SELECT e.user_id AS station, strftime(CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN date_trunc('minute', ts) ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS date,
  round(s.lat, 4) AS lat, round(s.lon, 4) AS lon, round(CASE WHEN event_type <> 'error' THEN value * 10 END, 4) AS EC_Phys_Water
FROM events e JOIN stations s ON s.station = e.user_id WHERE event_type <> 'signup'""",
    ("stations",),
)
def load_observations(t):
    e = F.col("event_id") % 3
    text = (
        F.when(F.col("event_type") == "signup", F.when(e == 0, "#n/a").otherwise("not a date"))
        .when(e == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(e == 1, F.date_format("ts", "yyyy/MM/dd HH:mm"))
        .otherwise(F.date_format("ts", "MM/dd/yyyy"))
    )
    value = F.when(F.col("event_type") == "error", F.when(e == 0, "NA").when(e == 1, "#n/a").otherwise("<5")).otherwise(F.col("value").cast("string"))
    raw = t.read("events").select(F.col("user_id").alias("station"), text.alias("date_time"), value.alias("EC_Phys_Water"))
    path = scratch_folder(t.spark, "stations")
    # Folders cost far more than their bytes, by which tasks would be joined. Tasks put their own folders in place;
    # otherwise the driver moves them one by one.
    writer = spread(raw, "station").write.partitionBy("station").option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.option("header", True).csv(path)
    out = ob.load_observations(t.spark, path, t.stations(), ["EC_Phys_Water"])
    return out.select(
        F.col("station").cast("bigint").alias("station"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.round("lat", 4).alias("lat"),
        F.round("lon", 4).alias("lon"), F.round("EC_Phys_Water", 4).alias("EC_Phys_Water"),
    )


@query("load_samples", "SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, day, target_a FROM samples", ("samples",))
def load_samples(t):
    text = F.when(F.col("sample_id") % 2 == 0, F.date_format("day", "dd-MM-yyyy")).otherwise(F.date_format("day", "d/M/yyyy"))
    raw = t.samples().select(
        F.round("lat", 4).cast("string").alias("Latitude"), F.round("lon", 4).cast("string").alias("Longitude"),
        text.alias("Sample Date"), F.col("target_a").cast("string").alias("target_a"),
    )
    path = scratch_folder(t.spark, "samples")
    raw.write.option("header", True).csv(path)
    return ob.load_samples(t.spark, path, ["target_a"])


@query(
    "ragged_csv_repair",
    "SELECT CAST(event_id AS VARCHAR) AS id, value AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS b FROM events",
)
def ragged_csv_repair(t):
    k = F.col("event_id") % 4
    tail = F.when(k == 0, F.lit(",oops")).when(k == 1, F.concat(F.lit(","), F.col("user_id"), F.lit(",extra,more"))).otherwise(F.concat(F.lit(","), F.col("user_id")))
    lines = t.read("events").select(F.concat(F.col("event_id"), F.lit(","), F.col("value"), tail).alias("value"))
    return ob.repair_ragged(lines, ["id", "a", "b"], ["id"])


@query("column_order_repair", "SELECT event_type, user_id, event_id FROM events")
def column_order_repair(t):
    return tb.column_order_repair(t.read("events"), ["event_type", "user_id", "event_id"])


@query(
    "incremental_fill",
    """, k AS (SELECT DISTINCT lat, lon FROM samples)
SELECT lat, lon, round(CASE WHEN EXISTS (SELECT 1 FROM stations s WHERE s.lat = k.lat AND s.lon = k.lon) THEN -1 ELSE lat + lon END, 6) AS elevation FROM k
UNION SELECT lat, lon, -1 FROM stations""",
    ("samples",),
)
def incremental_fill(t):
    cache = t.stations().select("lat", "lon").distinct().withColumn("elevation", F.lit(-1.0))
    fetch = lambda keys: keys.withColumn("elevation", F.col("lat") + F.col("lon"))
    return r6(tb.incremental_fill(t.samples(), cache, ["lat", "lon"], fetch, ["elevation"]), "elevation")


@query("cached_parquet", "SELECT station, day, target_a FROM observations", ("observations",))
def cached_parquet(t):
    path = scratch_folder(t.spark, "combined")
    build = lambda: t.observations().select("station", "day", "target_a")
    ob.cached_parquet(t.spark, path, build)
    return ob.cached_parquet(t.spark, path, build)


@query("predictions_sink", "SELECT station, CAST(day AS VARCHAR) AS day, round(pred, 6) AS pred FROM predictions", ("predictions",))
def predictions_sink(t):
    path = scratch_folder(t.spark, "predictions")
    ob.write_predictions(r6(t.predictions().select("station", "day", "pred"), "pred"), path)
    return t.spark.read.option("header", True).schema("station long, day string, pred double").csv(path)


@query(
    "embeddings_load",
    "SELECT vec_id AS word_id, concat('w', vec_id) AS word, [round(CAST(x AS DOUBLE), 6) FOR x IN embedding] AS vec FROM embeddings",
)
def embeddings_load(t):
    from terralex.functions.vectors import as_doubles
    from terralex.sources import vectors_io as vio

    path = scratch_folder(t.spark, "vectors")
    rows = t.read("embeddings").select(
        F.col("vec_id").alias("word_id"), F.concat(F.lit("w"), "vec_id").alias("word"), as_doubles(F.col("embedding")).alias("vec")
    )
    vio.save_vectors(rows, path)
    return vio.load_vectors(t.spark, path)


@query("html_link_extract", "SELECT page_id, CAST(pos AS INT) AS pos, href FROM links", ("links",))
def html_link_extract(t):
    return t.links()


@query(
    "link_pairing",
    """, tg AS (SELECT *, regexp_matches(href, '^/[A-Z]') AS m, regexp_matches(href, '^/[a-z]') AND NOT regexp_matches(href, '^/[A-Z]') AS t FROM links),
w AS (SELECT *, max(CASE WHEN m THEN pos END) OVER pw AS mp, max(CASE WHEN t THEN pos END) OVER pw AS tp FROM tg
  WINDOW pw AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT w.page_id, CAST(w.pos AS INT) AS pos, w.href AS target, l.href AS marker,
  'http://x.org/' || regexp_replace(l.href, '^[./]+', '') AS link, replace(string_split(l.href, '/')[-1], 'The', 'the') AS file
FROM w JOIN links l ON l.page_id = w.page_id AND l.pos = w.mp WHERE w.t AND w.mp IS NOT NULL AND (w.tp IS NULL OR w.mp > w.tp)""",
    ("links",),
)
def link_pairing(t):
    out = pg.pair_links(t.links(), "page_id", F.col("href").rlike("^/[A-Z]"), F.col("href").rlike("^/[a-z]"))
    marker = F.col("marker")
    return out.select(
        "page_id", "pos", "target", "marker", pg.absolute_link(marker, "http://x.org/").alias("link"),
        pg.file_name(marker, "The", "the").alias("file"),
    )


@query(
    "text_attribute_extract",
    """SELECT doc_id, round(-20 - (doc_id % 200) / 10e0, 4) AS lat, round(10 + (doc_id % 300) / 10e0, 4) AS lon FROM documents
WHERE round(-20 - (doc_id % 200) / 10e0, 4) > -36 AND round(-20 - (doc_id % 200) / 10e0, 4) < -20
  AND round(10 + (doc_id % 300) / 10e0, 4) > 16 AND round(10 + (doc_id % 300) / 10e0, 4) < 34""",
)
def text_attribute_extract(t):
    d = F.col("doc_id")
    lat = F.round(F.lit(-20.0) - (d % 200) / 10.0, 4).cast("string")
    lon = F.round(F.lit(10.0) + (d % 300) / 10.0, 4).cast("string")
    body = F.concat(F.col("text"), F.lit("\nLATITUDE  "), lat, F.lit(" Longitude "), lon, F.lit(" end"))
    return pg.extract_coordinates(t.read("documents").select("doc_id", body.alias("text")), "doc_id", "text")


@query(
    "rounded_key_join",
    """, r AS (SELECT round_even(lat, 4) AS lat, round_even(lon, 4) AS lon, min(station) AS station FROM stations GROUP BY 1, 2)
SELECT s.sample_id, round_even(s.lat, 4) AS lat, round_even(s.lon, 4) AS lon, r.station
FROM samples s LEFT JOIN r ON r.lat = round_even(s.lat, 4) AND r.lon = round_even(s.lon, 4)""",
    ("samples",),
)
def rounded_key_join(t):
    right = t.stations().select("lat", "lon", "station")
    return tb.rounded_key_join(t.samples().select("sample_id", "lat", "lon"), right, ["lat", "lon"], ["station"])


@query(
    "enrich_join",
    """, env AS (SELECT lat, lon, day, target_a AS rain FROM samples QUALIFY row_number() OVER (PARTITION BY lat, lon, day ORDER BY sample_id) = 1),
geo AS (SELECT round_even(lat, 4) AS klat, round_even(lon, 4) AS klon, min(station) AS station FROM stations GROUP BY 1, 2)
SELECT s.sample_id, e.rain, g.station AS cover FROM samples s JOIN env e ON e.lat = s.lat AND e.lon = s.lon AND e.day = s.day
LEFT JOIN geo g ON g.klat = round_even(s.lat, 4) AND g.klon = round_even(s.lon, 4)""",
    ("samples",),
)
def enrich_join(t):
    s = t.samples()
    env = s.select("lat", "lon", "day", F.col("target_a").alias("rain"), F.col("sample_id").alias("env_id"))
    geo = t.stations().select("lat", "lon", F.col("station").alias("cover"))
    out = tb.enrich_join(s.select("sample_id", "lat", "lon", "day"), env, geo, ["env_id"], ["cover"])
    return out.select("sample_id", "rain", "cover")


@query(
    "first_nonblank_record",
    """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderpriority END AS note FROM orders)
SELECT o_custkey, o_orderkey, note FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN trim(note) = '' THEN 1 ELSE 0 END, o_orderkey) = 1""",
)
def first_nonblank_record(t):
    note = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    rows = t.read("orders").select("o_custkey", "o_orderkey", note.alias("note"))
    return tb.first_nonblank_record(rows, "o_custkey", "o_orderkey", "note")


@query(
    "union_by_name",
    """SELECT station, day, target_a, CAST(NULL AS DOUBLE) AS price FROM observations UNION ALL SELECT station, day, NULL, CAST(sample_id AS DOUBLE) FROM placed""",
    ("observations", "placed"),
)
def union_by_name(t):
    return tb.union_by_name(
        t.observations().select("station", "day", "target_a"),
        t.placed().select("station", "day", F.col("sample_id").cast("double").alias("price")),
    )


@query("distinct_locations", "SELECT DISTINCT lat, lon FROM samples", ("samples",))
def distinct_locations(t):
    return tb.distinct_locations(t.samples())


@query(
    "dedup_keep_first",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
)
def dedup_keep_first(t):
    return tb.dedup_keep_first(t.read("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("key_set_union", "SELECT station, day FROM observations UNION SELECT station, day FROM placed", ("observations", "placed"))
def key_set_union(t):
    return tb.key_set_union(t.observations(), t.placed(), ["station", "day"])


@query("key_set_difference", "SELECT station, day FROM placed EXCEPT SELECT station, day FROM observations", ("observations", "placed"))
def key_set_difference(t):
    return tb.key_set_difference(t.placed(), t.observations(), ["station", "day"])


BANDS = ("green", "red", "nir08", "swir16")
SQL_SCENE = """, scene AS (SELECT e.label AS loc_id, DATE '2024-01-01' + CAST(p.loc_id % 120 AS INT) AS day,
  CASE p.y // 2 WHEN 0 THEN 'green' WHEN 1 THEN 'red' WHEN 2 THEN 'nir08' ELSE 'swir16' END AS band, p.y % 2 AS y, p.x, p.value
  FROM pixels p JOIN embeddings e ON e.vec_id = p.loc_id),
asked AS (SELECT DISTINCT label AS loc_id, DATE '2024-01-01' + CAST(vec_id % 4 * 30 + 29 AS INT) AS day FROM embeddings)
"""


@query(
    "composite_median",
    SQL_SCENE
    + """, pp AS (SELECT s.loc_id, a.day, s.band, s.y, s.x, median(s.value) AS m FROM scene s JOIN asked a ON a.loc_id = s.loc_id
  WHERE s.day BETWEEN a.day - 60 AND a.day GROUP BY ALL),
pb AS (SELECT loc_id, day, band, median(m) AS m FROM pp GROUP BY ALL),
w AS (SELECT loc_id, day, max(m) FILTER (band = 'green') AS green, max(m) FILTER (band = 'red') AS red, max(m) FILTER (band = 'nir08') AS nir08,
  max(m) FILTER (band = 'swir16') AS swir16 FROM pb GROUP BY ALL)
SELECT loc_id, day, round(green, 6) AS green, round(red, 6) AS red, round(nir08, 6) AS nir08, round(swir16, 6) AS swir16 FROM w""",
    ("pixels",),
)
def composite_median(t):
    e = t.read("embeddings")
    start = F.lit("2024-01-01").cast("date")
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]), (F.floor(F.col("y") / 2) + 1).cast("int"))
    scene = t.pixels().join(e.select(F.col("vec_id").alias("loc_id"), "label"), "loc_id").select(
        F.col("label").alias("loc_id"), F.date_add(start, (F.col("loc_id") % 120).cast("int")).alias("day"),
        band.alias("band"), (F.col("y") % 2).alias("y"), "x", "value",
    )
    asked = e.select(F.col("label").alias("loc_id"), F.date_add(start, (F.col("vec_id") % 4 * 30 + 29).cast("int")).alias("day")).distinct()
    return r6(ra.composite_median(scene, asked, BANDS).select("loc_id", "day", *BANDS), *BANDS)


@query(
    "class_fractions",
    """, c AS (SELECT loc_id, CASE CAST(floor(abs(value) * 40) AS INT) WHEN 0 THEN 10 WHEN 1 THEN 40 WHEN 2 THEN 50 WHEN 3 THEN 80 ELSE 0 END AS v FROM pixels)
SELECT loc_id, avg(CASE WHEN v = 10 THEN 1e0 ELSE 0e0 END) AS lc_tree_cover, avg(CASE WHEN v = 40 THEN 1e0 ELSE 0e0 END) AS lc_cropland,
  avg(CASE WHEN v = 50 THEN 1e0 ELSE 0e0 END) AS lc_built_up, avg(CASE WHEN v = 80 THEN 1e0 ELSE 0e0 END) AS lc_water,
  CAST(count(DISTINCT CASE WHEN v > 0 THEN v END) AS INT) AS lc_diversity FROM c GROUP BY loc_id""",
    ("pixels",),
)
def class_fractions(t):
    k = F.floor(F.abs("value") * 40)
    cls = F.when(k == 0, 10).when(k == 1, 40).when(k == 2, 50).when(k == 3, 80).otherwise(0)
    out = ra.class_fractions(t.pixels().withColumn("value", cls))
    return out.select("loc_id", "lc_tree_cover", "lc_cropland", "lc_built_up", "lc_water", "lc_diversity")


@query(
    "positive_pixel_stats",
    """SELECT loc_id, round(coalesce(avg(value) FILTER (value > 0), 0), 6) AS positive_mean, round(coalesce(max(value) FILTER (value > 0), 0), 6) AS positive_max,
  count(*) FILTER (value > 0) / count(*)::DOUBLE AS positive_share FROM pixels GROUP BY loc_id""",
    ("pixels",),
)
def positive_pixel_stats(t):
    return r6(ra.positive_pixel_stats(t.pixels()), "positive_mean", "positive_max")


@query(
    "terrain_stats",
    """, g AS (SELECT *, CASE WHEN lag(value) OVER wx IS NULL THEN lead(value) OVER wx - value WHEN lead(value) OVER wx IS NULL THEN value - lag(value) OVER wx
    ELSE (lead(value) OVER wx - lag(value) OVER wx) / 2 END AS gx,
  CASE WHEN lag(value) OVER wy IS NULL THEN lead(value) OVER wy - value WHEN lead(value) OVER wy IS NULL THEN value - lag(value) OVER wy
    ELSE (lead(value) OVER wy - lag(value) OVER wy) / 2 END AS gy
  FROM pixels WINDOW wx AS (PARTITION BY loc_id, y ORDER BY x), wy AS (PARTITION BY loc_id, x ORDER BY y)),
s AS (SELECT g.*, sqrt(pow(gx / (0.00027777777e0 * 111132e0 * cos(radians(-30e0 + loc_id % 10))), 2) + pow(gy / (0.00027777777e0 * 111132e0), 2)) AS slope, atan2(gy, -gx) AS aspect FROM g)
SELECT loc_id, round(avg(value), 6) AS elevation_mean, round(stddev_pop(value), 6) AS elevation_std, round(avg(slope), 6) AS slope_mean, round(max(slope), 6) AS slope_max,
  round(stddev_pop(slope), 6) AS slope_std, round(avg(aspect), 6) AS aspect_mean, round(max(value) - min(value), 6) AS valley_depth FROM s GROUP BY loc_id""",
    ("pixels",),
)
def terrain_stats(t):
    locs = t.read("embeddings").select(F.col("vec_id").alias("loc_id"), (F.lit(-30.0) + F.col("vec_id") % 10).alias("lat"))
    out = ra.terrain_stats(t.pixels(), locs)
    return r6(out, *[c for c in out.columns if c != "loc_id"])


@query(
    "weather_trailing",
    """, q AS (SELECT DISTINCT station AS loc_id, day + 10 AS day FROM placed),
j AS (SELECT q.loc_id, q.day, w.rain, w.et, row_number() OVER (PARTITION BY q.loc_id, q.day ORDER BY w.day DESC) AS rn
  FROM q JOIN daily_weather w ON w.loc_id = q.loc_id AND w.day BETWEEN q.day - 30 AND q.day),
a AS (SELECT loc_id, day, sum(coalesce(rain, 0)) AS r30, sum(CASE WHEN rn <= 7 THEN coalesce(rain, 0) ELSE 0 END) AS r7,
  sum(coalesce(et, 0)) AS e30, sum(CASE WHEN rn <= 7 THEN coalesce(et, 0) ELSE 0 END) AS e7 FROM j GROUP BY ALL)
SELECT p.sample_id, round(r7, 4) AS rain_7d, round(r30, 4) AS rain_30d, round(e7, 4) AS et_7d, round(e30, 4) AS et_30d, round(r30 - e30, 4) AS water_balance_30d
FROM placed p LEFT JOIN a ON a.loc_id = p.station AND a.day = p.day + 10""",
    ("placed", "daily_weather"),
)
def weather_trailing(t):
    asked = t.placed().select("sample_id", F.col("station").alias("loc_id"), F.date_add("day", 10).alias("day"))
    out = ra.weather_trailing(asked, t.daily_weather())
    names = ["rain_7d", "rain_30d", "et_7d", "et_30d", "water_balance_30d"]
    return out.select("sample_id", *[F.round(c, 4).alias(c) for c in names])
