"""Registered queries: station summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.operators import profiles as pf
from terralex.plans.adapters import AUX, TARGETS
from terralex.plans.q_temporal import r6
from terralex.plans.registry import query

CUTOFF = "2024-01-20"

HIST = """, hist AS (SELECT o.* FROM observations o JOIN (SELECT station, count(*) FILTER (day <= DATE '2024-01-20') AS n
    FROM observations GROUP BY station) c USING (station) WHERE day <= DATE '2024-01-20' OR c.n < 3),
vals AS (SELECT station, day, col, value FROM hist UNPIVOT (value FOR col IN (target_a, target_b, target_c)))
"""


@query(
    "station_profile",
    HIST
    + """SELECT station, col, round(avg(value), 6) AS mean, CASE WHEN count(*) >= 3 THEN round(median(value), 6) END AS median,
  CASE WHEN count(*) >= 3 THEN round(stddev_pop(value), 6) END AS std,
  CASE WHEN count(*) >= 3 THEN round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) END AS iqr,
  CASE WHEN count(*) >= 3 THEN round(stddev_pop(value) / (avg(value) + 1e-8), 6) END AS cv,
  CASE WHEN count(*) >= 3 THEN round(quantile_cont(value, 0.1), 6) END AS p10,
  CASE WHEN count(*) >= 3 THEN round(quantile_cont(value, 0.9), 6) END AS p90,
  CASE WHEN count(*) >= 3 THEN count(*) END AS count
FROM vals GROUP BY station, col""",
    ("observations",),
)
def station_profile(t):
    return r6(pf.station_profile(t.observations(), TARGETS, CUTOFF), "mean", "median", "std", "iqr", "cv", "p10", "p90")


@query(
    "seasonal_harmonic",
    """, v AS (SELECT o_custkey % 150 AS station, CAST(o_orderdate AS DATE) AS day, ln(o_totalprice) AS value FROM orders),
m AS (SELECT station, month(day) AS mo, avg(value) AS mm FROM v GROUP BY ALL),
a AS (SELECT station, avg(value) AS am, count(*) AS n FROM v GROUP BY ALL),
f AS (SELECT a.station, k.mo, a.n, coalesce(m.mm, a.am) AS mv FROM a, (SELECT unnest(range(1, 13)) AS mo) k
  LEFT JOIN m ON m.station = a.station AND m.mo = k.mo),
c AS (SELECT *, mv - avg(mv) OVER (PARTITION BY station) AS mc FROM f),
p AS (SELECT station, max(n) AS n, sum(mc * cos(2 * pi() * (mo - 1) / 12)) / 6 AS c, sum(mc * sin(2 * pi() * (mo - 1) / 12)) / 6 AS s FROM c GROUP BY station)
SELECT station, round(sqrt(c * c + s * s), 6) AS season_amp, round(atan2(s, c), 6) AS season_phase FROM p WHERE n >= 3""",
    ("stations",),
)
def seasonal_harmonic(t):
    obs = t.read("orders").select(
        (F.col("o_custkey") % 150).alias("station"), F.col("o_orderdate").cast("date").alias("day"), F.log("o_totalprice").alias("v")
    )
    out = pf.seasonal_harmonic(obs, ["v"], "2100-01-01").filter(F.col("season_amp").isNotNull())
    return out.select("station", F.round("season_amp", 6).alias("season_amp"), F.round("season_phase", 6).alias("season_phase"))


@query(
    "trend_slope",
    HIST
    + """SELECT station, col, round(CASE WHEN count(*) >= 10 THEN coalesce(regr_slope(value, date_diff('day', DATE '2000-01-01', day) / 365.25e0), 0) ELSE 0 END, 3) AS trend
FROM vals GROUP BY station, col""",
    ("observations",),
)
def trend_slope(t):
    return pf.trend_slope(t.observations(), TARGETS, CUTOFF).withColumn("trend", F.round("trend", 3))


@query(
    "recent_window_stats",
    """, v AS (SELECT o_custkey % 150 AS station, CAST(o_orderdate AS DATE) AS day, ln(o_totalprice) AS value FROM orders),
h AS (SELECT v.* FROM v JOIN (SELECT station, count(*) FILTER (day <= DATE '1998-06-30') AS n FROM v GROUP BY station) c USING (station)
  WHERE day <= DATE '1998-06-30' OR c.n < 3),
a AS (SELECT station, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s,
  count(*) FILTER (day BETWEEN DATE '1996-06-30' AND DATE '1998-06-30') AS n2, avg(value) FILTER (day BETWEEN DATE '1996-06-30' AND DATE '1998-06-30') AS m2,
  stddev_pop(value) FILTER (day BETWEEN DATE '1996-06-30' AND DATE '1998-06-30') AS s2,
  count(*) FILTER (day BETWEEN DATE '1993-06-30' AND DATE '1998-06-30') AS n5, avg(value) FILTER (day BETWEEN DATE '1993-06-30' AND DATE '1998-06-30') AS m5,
  stddev_pop(value) FILTER (day BETWEEN DATE '1993-06-30' AND DATE '1998-06-30') AS s5 FROM h GROUP BY station)
SELECT station, round(CASE WHEN n2 >= 2 THEN m2 ELSE m END, 6) AS recent_2y_mean, round(CASE WHEN n2 >= 2 THEN s2 WHEN n >= 3 THEN s END, 6) AS recent_2y_std,
  round(CASE WHEN n5 >= 2 THEN m5 ELSE m END, 6) AS recent_5y_mean, round(CASE WHEN n5 >= 2 THEN s5 WHEN n >= 3 THEN s END, 6) AS recent_5y_std FROM a""",
    ("stations",),
)
def recent_window_stats(t):
    obs = t.read("orders").select(
        (F.col("o_custkey") % 150).alias("station"), F.col("o_orderdate").cast("date").alias("day"), F.log("o_totalprice").alias("v")
    )
    out = pf.recent_window_stats(obs, ["v"], "1998-06-30").drop("col")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "station"})


@query(
    "pairwise_corr",
    HIST
    + """SELECT station,
  round(CASE WHEN count(*) FILTER (target_a IS NOT NULL AND target_b IS NOT NULL) >= 10 THEN corr(target_a, target_b) ELSE 0 END, 6) AS corr_target_a_target_b,
  round(CASE WHEN count(*) FILTER (target_a IS NOT NULL AND target_c IS NOT NULL) >= 10 THEN corr(target_a, target_c) ELSE 0 END, 6) AS corr_target_a_target_c,
  round(CASE WHEN count(*) FILTER (target_b IS NOT NULL AND target_c IS NOT NULL) >= 10 THEN corr(target_b, target_c) ELSE 0 END, 6) AS corr_target_b_target_c
FROM hist GROUP BY station""",
    ("observations",),
)
def pairwise_corr(t):
    out = pf.pairwise_corr(t.observations(), TARGETS, CUTOFF)
    return r6(out, *[c for c in out.columns if c != "station"])


@query(
    "station_aux_stats",
    """, vals AS (SELECT station, day, col, value FROM observations UNPIVOT (value FOR col IN (aux_1, aux_2))),
mm AS (SELECT station, col, max(m) - min(m) AS rng FROM (SELECT station, col, month(day) AS mo, avg(value) AS m FROM vals GROUP BY ALL) GROUP BY ALL),
sp AS (SELECT station, count(*) AS n_obs, date_diff('day', min(day), max(day)) / 365.25e0 AS span_years FROM observations GROUP BY station)
SELECT v.station, v.col, round(avg(value), 6) AS mean, round(CASE WHEN count(*) >= 3 THEN stddev_samp(value) END, 6) AS std,
  round(CASE WHEN count(*) >= 3 THEN median(value) END, 6) AS median,
  round(CASE WHEN count(*) >= 3 THEN stddev_samp(value) / (avg(value) + 1e-8) END, 6) AS cv,
  round(CASE WHEN count(*) >= 3 THEN any_value(mm.rng) END, 6) AS season_range, any_value(n_obs) AS n_obs, round(any_value(span_years), 6) AS span_years
FROM vals v JOIN mm USING (station, col) JOIN sp USING (station) GROUP BY v.station, v.col""",
    ("observations",),
)
def station_aux_stats(t):
    out = pf.station_aux_stats(t.observations(), AUX)
    return r6(out, "mean", "std", "median", "cv", "season_range", "span_years")


@query(
    "decay_weighted_stats",
    """, vals AS (SELECT station, day, col, value FROM observations UNPIVOT (value FOR col IN (aux_1, aux_2))),
l AS (SELECT station, max(day) AS ld, count(*) AS n FROM observations GROUP BY station HAVING count(*) >= 3),
w AS (SELECT v.*, exp(-ln(2) / 730e0 * date_diff('day', v.day, l.ld)) AS w FROM vals v JOIN l USING (station)),
a AS (SELECT station, col, sum(w * value) / sum(w) AS m, avg(value) AS p FROM w GROUP BY ALL HAVING count(*) >= 3 AND sum(w) >= 1e-10)
SELECT station, col, round(any_value(m), 6) AS tw_mean, round(sqrt(sum(w * (value - m) ** 2) / sum(w)), 6) AS tw_std,
  round(any_value(m) - any_value(p), 6) AS tw_trend FROM w JOIN a USING (station, col) GROUP BY station, col""",
    ("observations",),
)
def decay_weighted_stats(t):
    return r6(pf.decay_weighted_stats(t.observations(), AUX), "tw_mean", "tw_std", "tw_trend")


@query(
    "station_stats",
    """, excl AS (SELECT DISTINCT station, day FROM placed WHERE sample_id % 5 = 0),
v AS (SELECT station, target_a AS value FROM observations o WHERE target_a IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM excl e WHERE e.station = o.station AND e.day = o.day))
SELECT station, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS min, max(value) AS max, count(*) AS n
FROM v GROUP BY station HAVING count(*) >= 5""",
    ("observations", "placed"),
)
def station_stats(t):
    exclude = t.placed().filter(F.col("sample_id") % 5 == 0).select("station", "day").distinct()
    out = pf.station_stats(t.observations(), "target_a", exclude)
    return r6(out, "mean", "std", "median", "q25", "q75")


@query(
    "winsorize",
    """SELECT o_orderkey, round(least(greatest(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)),
  (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)), 4) AS o_totalprice FROM orders""",
)
def winsorize(t):
    out = pf.winsorize(t.read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))
