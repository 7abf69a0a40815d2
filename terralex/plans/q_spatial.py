"""Registered queries: coordinate matching, neighbours and radius counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.operators import spatial as sp
from terralex.plans.adapters import AUX, TARGETS
from terralex.plans.q_temporal import r6
from terralex.plans.registry import query

MATCHED = """, coords AS (SELECT DISTINCT lat, lon FROM samples),
hits AS (SELECT c.lat, c.lon, min(s.station) AS station FROM coords c JOIN stations s
  ON abs(c.lat - s.lat) < 5e-3 AND abs(c.lon - s.lon) < 5e-3 GROUP BY ALL),
matched AS (SELECT p.sample_id, p.lat, p.lon, p.day, h.station FROM samples p LEFT JOIN hits h ON p.lat = h.lat AND p.lon = h.lon)
"""


@query("coord_to_station", MATCHED + "SELECT sample_id, station FROM matched", ("samples",))
def coord_to_station(t):
    return sp.coord_to_station(t.samples(), t.stations()).select("sample_id", "station")


@query(
    "station_discovery",
    """, locs AS (SELECT DISTINCT round(lat, 6) AS lat, round(lon, 6) AS lon FROM samples)
SELECT s.station, l.lat AS match_lat, l.lon AS match_lon, round(sqrt((l.lat - s.lat)**2 + (l.lon - s.lon)**2), 6) AS dist
FROM stations s JOIN locs l ON abs(l.lat - s.lat) < 2e-2 AND abs(l.lon - s.lon) < 2e-2
QUALIFY row_number() OVER (PARTITION BY s.station ORDER BY l.lat, l.lon) = 1""",
    ("samples",),
)
def station_discovery(t):
    return r6(sp.station_discovery(t.stations(), t.samples()).select("station", "match_lat", "match_lon", "dist"), "dist")


@query(
    "leakage_anti_join",
    MATCHED
    + """SELECT o.station, o.day, o.target_a FROM observations o
WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.station = o.station AND m.day = o.day)""",
    ("samples", "observations"),
)
def leakage_anti_join(t):
    return sp.leakage_anti_join(t.observations(), t.stations(), t.samples()).select("station", "day", "target_a")


@query(
    "nearest_station_fill",
    MATCHED
    + """, lost AS (SELECT DISTINCT lat, lon FROM matched WHERE station IS NULL),
near AS (SELECT l.lat, l.lon, s.station, sqrt((l.lat - s.lat)**2 + (l.lon - s.lon)**2) AS dist FROM lost l, stations s
  QUALIFY row_number() OVER (PARTITION BY l.lat, l.lon ORDER BY dist, s.station) = 1),
days AS (SELECT DISTINCT n.station, m.day FROM matched m JOIN near n ON m.lat = n.lat AND m.lon = n.lon WHERE n.dist <= 0.5 AND m.station IS NULL),
rows AS (SELECT d.station, d.day, o.aux_1, o.aux_2 FROM days d JOIN observations o
  ON o.station = d.station AND o.day BETWEEN d.day - 30 AND d.day + 30
  QUALIFY row_number() OVER (PARTITION BY d.station, d.day ORDER BY abs(date_diff('day', d.day, o.day)), o.day) = 1)
SELECT m.sample_id, m.station, r.aux_1, r.aux_2 FROM matched m
LEFT JOIN near n ON m.station IS NULL AND m.lat = n.lat AND m.lon = n.lon AND n.dist <= 0.5
LEFT JOIN rows r ON r.station = n.station AND r.day = m.day""",
    ("samples", "observations"),
)
def nearest_station_fill(t):
    none = {c: F.lit(None).cast("double") for c in AUX}
    matched = sp.coord_to_station(t.samples(), t.stations()).withColumns(none)
    out = sp.nearest_station_fill(matched, t.stations(), t.observations(), AUX)
    return out.select("sample_id", "station", *AUX)


@query(
    "idw_station_fill",
    MATCHED
    + """, feats AS (SELECT station, avg(target_a) AS mean_a, avg(target_b) AS mean_b FROM observations GROUP BY station),
lost AS (SELECT DISTINCT lat, lon FROM matched WHERE station IS NULL),
near AS (SELECT l.lat, l.lon, s.station, sqrt((l.lat - s.lat)**2 + (l.lon - s.lon)**2) AS dist FROM lost l, stations s
  QUALIFY row_number() OVER (PARTITION BY l.lat, l.lon ORDER BY dist, s.station) <= 3),
far AS (SELECT n.lat, n.lon, sum(f.mean_a / (dist + 1e-3)) / sum(CASE WHEN f.mean_a IS NOT NULL THEN 1 / (dist + 1e-3) END) AS fa,
  sum(f.mean_b / (dist + 1e-3)) / sum(CASE WHEN f.mean_b IS NOT NULL THEN 1 / (dist + 1e-3) END) AS fb
  FROM near n JOIN feats f USING (station) GROUP BY ALL)
SELECT m.sample_id, m.station, round(CASE WHEN m.station IS NULL THEN fa ELSE f.mean_a END, 6) AS mean_a,
  round(CASE WHEN m.station IS NULL THEN fb ELSE f.mean_b END, 6) AS mean_b
FROM matched m LEFT JOIN feats f ON m.station = f.station LEFT JOIN far ON m.lat = far.lat AND m.lon = far.lon""",
    ("samples", "observations"),
)
def idw_station_fill(t):
    feats = t.observations().groupBy("station").agg(F.avg("target_a").alias("mean_a"), F.avg("target_b").alias("mean_b"))
    matched = sp.coord_to_station(t.samples(), t.stations())
    out = sp.idw_station_fill(matched, feats, t.stations(), ["mean_a", "mean_b"])
    return r6(out.select("sample_id", "station", "mean_a", "mean_b"), "mean_a", "mean_b")


@query(
    "neighbor_idw",
    """, nb AS (SELECT a.station, b.station AS neighbor, sqrt((a.lat - b.lat)**2 + (a.lon - b.lon)**2) AS dist
  FROM stations a JOIN stations b ON a.region = b.region AND a.station <> b.station
  WHERE dist <= 2.0 QUALIFY row_number() OVER (PARTITION BY a.station ORDER BY dist, b.station) <= 5),
asked AS (SELECT DISTINCT station, day FROM placed),
last AS (SELECT a.station, a.day, nb.dist, o.target_a, o.target_b, o.target_c
  FROM asked a JOIN nb USING (station) ASOF JOIN observations o ON o.station = nb.neighbor AND o.day < a.day),
agg AS (SELECT station, day,
  sum(target_a / (dist + 1e-2)) / sum(CASE WHEN target_a IS NOT NULL THEN 1 / (dist + 1e-2) END) AS wa, min(target_a) AS mna, max(target_a) AS mxa,
  sum(target_b / (dist + 1e-2)) / sum(CASE WHEN target_b IS NOT NULL THEN 1 / (dist + 1e-2) END) AS wb, min(target_b) AS mnb, max(target_b) AS mxb,
  count(*) FILTER (coalesce(target_a, target_b, target_c) IS NOT NULL) AS n,
  avg(dist) FILTER (coalesce(target_a, target_b, target_c) IS NOT NULL) AS md
  FROM last GROUP BY ALL)
SELECT p.sample_id, round(wa, 6) AS nbr_target_a_wmean, mna AS nbr_target_a_min, mxa AS nbr_target_a_max,
  round(wb, 6) AS nbr_target_b_wmean, mnb AS nbr_target_b_min, mxb AS nbr_target_b_max,
  CASE WHEN n > 0 THEN n END AS nbr_n, round(md, 6) AS nbr_mean_dist
FROM placed p LEFT JOIN agg USING (station, day)""",
    ("stations", "observations", "placed"),
)
def neighbor_idw(t):
    out = sp.neighbor_idw(t.placed(), t.stations(), t.observations(), TARGETS)
    names = [f"nbr_{c}_{s}" for c in TARGETS[:2] for s in ("wmean", "min", "max")] + ["nbr_n", "nbr_mean_dist"]
    return r6(out.select("sample_id", *names), "nbr_target_a_wmean", "nbr_target_b_wmean", "nbr_mean_dist")


HAV = "2 * 6371e0 * asin(sqrt(least(1e0, sin(radians({a}.lat - {b}.lat) / 2)**2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({a}.lon - {b}.lon) / 2)**2)))"


@query(
    "haversine_knn_features",
    """, firsts AS (SELECT sample_id, lat, lon, target_a FROM samples QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY sample_id) <= 11),
locs AS (SELECT DISTINCT lat, lon FROM samples),
dists AS (SELECT a.lat, a.lon, b.lat AS rlat, b.lon AS rlon, """
    + HAV.format(a="a", b="b")
    + """ AS dist FROM locs a, locs b),
cand AS (SELECT d.lat, d.lon, d.dist, f.sample_id AS nid, f.target_a AS v FROM dists d JOIN firsts f ON f.lat = d.rlat AND f.lon = d.rlon
  QUALIFY row_number() OVER (PARTITION BY d.lat, d.lon ORDER BY d.dist, f.sample_id) <= 11),
rk AS (SELECT s.sample_id, c.dist, c.v, row_number() OVER (PARTITION BY s.sample_id ORDER BY c.dist, c.nid) AS rn
  FROM samples s JOIN cand c ON c.lat = s.lat AND c.lon = s.lon AND c.nid <> s.sample_id)
SELECT sample_id,
  round(avg(v) FILTER (rn <= 5), 3) AS knn5_target_a_mean, round(avg(v) FILTER (rn <= 10), 3) AS knn10_target_a_mean,
  round((sum(v / (dist + 1)) FILTER (rn <= 5)) / ((sum(1 / (dist + 1)) FILTER (rn <= 5)) + 1e-8), 3) AS knn5_target_a_wmean,
  round((sum(v / (dist + 1)) FILTER (rn <= 10)) / ((sum(1 / (dist + 1)) FILTER (rn <= 10)) + 1e-8), 3) AS knn10_target_a_wmean,
  round(min(dist), 6) AS nn_dist_km
FROM rk GROUP BY sample_id""",
    ("samples",),
)
def haversine_knn_features(t):
    s = t.samples()
    out = sp.haversine_knn_features(s, s, "sample_id", ["target_a"], (5, 10), is_train=True)
    names = [f"knn{k}_target_a_{m}" for k in (5, 10) for m in ("mean", "wmean")]
    out = out.select("sample_id", *names, "nn_dist_km").withColumns({n: F.round(n, 3) for n in names})
    return r6(out, "nn_dist_km")


SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'DJF' WHEN month({0}) IN (3, 4, 5) THEN 'MAM' WHEN month({0}) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


@query(
    "season_idw_enrichment",
    """, enr AS (SELECT round_even(lat, 4) AS lat, round_even(lon, 4) AS lon, """
    + SEASON.format("o.o_orderdate")
    + """ AS season, s.target_a FROM samples s JOIN orders o ON o.o_orderkey = s.sample_id),
days AS (SELECT o.station, o.day + CAST((o.station * 37) % 365 AS INT) AS day, s.lat + 0.01 AS lat, s.lon + 0.01 AS lon FROM observations o JOIN stations s USING (station)),
obs AS (SELECT *, """
    + SEASON.format("day")
    + """ AS season FROM days),
bs AS (SELECT lat, lon, season, median(target_a) AS m FROM enr GROUP BY ALL),
bt AS (SELECT lat, lon, median(target_a) AS m FROM enr GROUP BY ALL),
q AS (SELECT DISTINCT lat, lon FROM obs),
asked AS (SELECT DISTINCT lat, lon, season FROM obs),
near AS (SELECT q.lat AS qlat, q.lon AS qlon, bt.lat, bt.lon, bt.m, """
    + HAV.format(a="q", b="bt")
    + """ AS dist FROM q, bt QUALIFY row_number() OVER (PARTITION BY q.lat, q.lon ORDER BY dist, bt.lat, bt.lon) <= 3),
agg AS (SELECT a.lat AS qlat, a.lon AS qlon, a.season, sum(coalesce(bs.m, near.m) / (dist + 1)) / sum(1 / (dist + 1)) AS v, min(dist) AS km
  FROM asked a JOIN near ON near.qlat = a.lat AND near.qlon = a.lon
  LEFT JOIN bs ON bs.lat = near.lat AND bs.lon = near.lon AND bs.season = a.season GROUP BY ALL)
SELECT o.station, o.day, round(v, 4) AS target_a, 1 AS has_enrichment, round(km, 6) AS enrichment_km
FROM obs o JOIN agg ON o.lat = qlat AND o.lon = qlon AND o.season = agg.season""",
    ("samples", "observations"),
)
def season_idw_enrichment(t):
    # Stations start on different days of the year, so every season is met.
    start = F.date_add("day", ((F.col("station") * 37) % 365).cast("int")).alias("day")
    obs = t.observations().select("station", "day").join(t.stations(), "station").select(
        "station", start, (F.col("lat") + 0.01).alias("lat"), (F.col("lon") + 0.01).alias("lon")
    )
    dated = t.read("orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderdate").cast("date").alias("day"))
    out = sp.season_idw_enrichment(obs, t.samples().drop("day").join(dated, "sample_id"), ["target_a"])
    out = out.select("station", "day", "target_a", "has_enrichment", "enrichment_km")
    return r6(out.withColumn("target_a", F.round("target_a", 4)), "enrichment_km")


@query(
    "poi_radius_features",
    """, locs AS (SELECT DISTINCT lat, lon FROM samples),
pairs AS (SELECT l.lat, l.lon, p.tag, """
    + HAV.format(a="l", b="p")
    + """ AS km, sqrt((l.lat - p.lat)**2 + (l.lon - p.lon)**2) AS deg FROM locs l JOIN pois p ON abs(l.lat - p.lat) < 0.2 AND abs(l.lon - p.lon) < 0.4),
agg AS (SELECT lat, lon, count(*) FILTER (tag = 'AUTOMOBILE') AS n_automobile, count(*) FILTER (tag = 'BUILDING') AS n_building,
  count(*) FILTER (tag = 'FURNITURE') AS n_furniture, count(*) FILTER (tag = 'HOUSEHOLD') AS n_household,
  count(*) FILTER (tag = 'MACHINERY') AS n_machinery, max(CASE WHEN tag IN ('BUILDING', 'FURNITURE') THEN 1 ELSE 0 END) AS hb, min(deg) FILTER (tag IN ('BUILDING', 'FURNITURE')) AS nd
  FROM pairs WHERE km <= 10 GROUP BY ALL)
SELECT l.lat, l.lon, coalesce(n_automobile, 0) AS n_automobile, coalesce(n_building, 0) AS n_building,
  coalesce(n_furniture, 0) AS n_furniture, coalesce(n_household, 0) AS n_household, coalesce(n_machinery, 0) AS n_machinery, coalesce(hb, 0) AS has_barrier,
  round(nd * 111320e0, 4) AS barrier_m,
  CASE WHEN coalesce(greatest(n_automobile, n_building, n_furniture, n_household, n_machinery), 0) = 0 THEN 0
    WHEN n_automobile = greatest(n_automobile, n_building, n_furniture, n_household, n_machinery) THEN 1
    WHEN n_building = greatest(n_automobile, n_building, n_furniture, n_household, n_machinery) THEN 2
    WHEN n_furniture = greatest(n_automobile, n_building, n_furniture, n_household, n_machinery) THEN 3
    WHEN n_household = greatest(n_automobile, n_building, n_furniture, n_household, n_machinery) THEN 4 ELSE 5 END AS dominant
FROM locs l LEFT JOIN agg USING (lat, lon)""",
    ("samples", "pois"),
)
def poi_radius_features(t):
    tags = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = sp.poi_radius_features(t.samples(), t.pois(), 10.0, tags, ["BUILDING", "FURNITURE"], tags)
    return out.withColumn("barrier_m", F.round("barrier_m", 4))
