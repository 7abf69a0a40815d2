"""Registered queries: scoring and data-quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.operators import metrics as mt
from terralex.operators import quality as qa
from terralex.plans.adapters import AUX, TARGETS
from terralex.plans.q_temporal import r6
from terralex.plans.registry import query

COLS = (*TARGETS, *AUX)
ALL_COLS = "target_a, target_b, target_c, aux_1, aux_2"


def biased(t):
    """Predictions against the history: every observed station-day, missing truth included."""
    pred = F.coalesce("target_b", "target_c", F.lit(50.0)) * 0.9 + 5.0
    return t.observations().select("station", "day", pred.alias("pred"))


BIASED = """, pr AS (SELECT station, day, coalesce(target_b, target_c, 50e0) * 0.9e0 + 5e0 AS pred FROM observations),
sc AS (SELECT pr.*, o.target_a AS truth FROM pr LEFT JOIN observations o USING (station, day))
"""


@query("score_match", BIASED + "SELECT station, day, round(pred, 6) AS pred, truth, truth IS NOT NULL AS matched FROM sc", ("observations",))
def score_match(t):
    return r6(mt.score_match(biased(t), t.observations(), "target_a", ["day"]), "pred")


@query(
    "regression_metrics",
    """SELECT round(1 - sum((truth - pred)**2) / (var_pop(truth) * count(*)), 6) AS r2, round(sqrt(avg((truth - pred)**2)), 6) AS rmse,
  round(avg(abs(truth - pred)), 6) AS mae, round(corr(truth, pred), 6) AS pearson, count(*) AS n_matched, CAST(0 AS BIGINT) AS n_missed,
  round(avg(truth), 6) AS truth_mean, min(truth) AS truth_min, max(truth) AS truth_max, round(avg(pred), 6) AS pred_mean,
  round(min(pred), 6) AS pred_min, round(max(pred), 6) AS pred_max FROM predictions""",
    ("predictions",),
)
def regression_metrics(t):
    out = mt.regression_metrics(t.predictions())
    return r6(out, *[c for c in out.columns if not c.startswith("n_") and c not in ("truth_min", "truth_max")])


@query(
    "per_station_r2",
    """SELECT station, round(1 - sum((truth - pred)**2) / nullif(var_pop(truth) * count(*), 0), 6) AS r2, count(*) AS n, round(avg(truth), 6) AS truth_mean
FROM predictions GROUP BY station HAVING count(*) >= 2""",
    ("predictions",),
)
def per_station_r2(t):
    return r6(mt.per_station_r2(t.predictions()), "r2", "truth_mean")


@query(
    "worst_k",
    BIASED
    + """SELECT station, round(1 - sum((truth - pred)**2) / nullif(var_pop(truth) * count(*), 0), 6) AS r2, count(*) AS n
FROM sc WHERE truth IS NOT NULL GROUP BY station HAVING count(*) >= 2 AND var_pop(truth) > 0 ORDER BY r2, station LIMIT 5""",
    ("observations",),
)
def worst_k(t):
    scored = mt.score_match(biased(t), t.observations(), "target_a", ["day"])
    return mt.worst_k(r6(mt.per_station_r2(scored).select("station", "r2", "n"), "r2"), "r2", 5, "station")


@query(
    "top_k_by_score",
    """SELECT station, count(target_a) AS n_values FROM observations GROUP BY station ORDER BY n_values DESC, station LIMIT 25""",
    ("observations",),
)
def top_k_by_score(t):
    counts = t.observations().groupBy("station").agg(F.count("target_a").alias("n_values"))
    return mt.top_k_by_score(counts, F.col("n_values"), 25, "station")


@query(
    "competition_score",
    """, l AS (SELECT col AS target, value AS truth, value * (9e-1 + 2e-2 * ((station * 13 + day(day)) % 10)) AS pred
  FROM observations UNPIVOT (value FOR col IN (target_a, target_b, target_c))),
r AS (SELECT target, 1 - sum((truth - pred)**2) / (var_pop(truth) * count(*)) AS r2 FROM l GROUP BY target)
SELECT round(avg(r2), 6) AS score, count(*) AS n_targets FROM r""",
    ("observations",),
)
def competition_score(t):
    from terralex.operators.quantiles import melt

    bias = F.lit(0.9) + F.lit(0.02) * ((F.col("station") * 13 + F.dayofmonth("day")) % 10)
    long = melt(t.observations(), ["station", "day"], TARGETS).filter(F.col("value").isNotNull())
    scored = long.select(F.col("col").alias("target"), F.col("value").alias("truth"), (F.col("value") * bias).alias("pred"))
    return r6(mt.competition_score(scored), "score")


@query(
    "roc_auc",
    """WITH r AS (SELECT event_type = 'purchase' AS pos, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2e0 AS rk FROM events),
s AS (SELECT sum(CASE WHEN pos THEN rk ELSE 0 END) AS rs, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2e0) / (p * n::DOUBLE), 8) AS auc, p AS n_pos, n AS n_neg FROM s""",
)
def roc_auc(t):
    rows = t.read("events").select((F.col("event_type") == "purchase").alias("label"), "value")
    return mt.roc_auc(rows, "label", "value").withColumn("auc", F.round("auc", 8))


@query(
    "within_group_variance_filter",
    f""", u AS (SELECT station, col, value FROM (SELECT station, station * 1e0 AS fixed, {ALL_COLS} FROM observations)
  UNPIVOT INCLUDE NULLS (value FOR col IN (fixed, {ALL_COLS}))),
g AS (SELECT station, col, count(*) AS rows, stddev_samp(value) AS s FROM u GROUP BY ALL),
w AS (SELECT col, sum(s * rows) / sum(CASE WHEN s IS NOT NULL THEN rows END) AS ws FROM g GROUP BY col),
t AS (SELECT col, stddev_samp(value) AS ts FROM u GROUP BY col)
SELECT col AS feature, round(ws, 6) AS within_std, round(ts, 6) AS total_std, round(ws / ts, 6) AS ratio, ws / ts >= 0.03 AS keep FROM w JOIN t USING (col)""",
    ("observations",),
)
def within_group_variance_filter(t):
    obs = t.observations().withColumn("fixed", F.col("station").cast("double"))
    return r6(qa.within_group_ratio(obs, ["fixed", *COLS], "station"), "within_std", "total_std", "ratio")


@query(
    "missing_profile",
    f""", u AS (SELECT col, value FROM (SELECT station * 1e0 AS station_d, {ALL_COLS} FROM observations) UNPIVOT INCLUDE NULLS (value FOR col IN (station_d, {ALL_COLS})))
SELECT col, count(*) FILTER (value IS NULL) AS n_missing, round(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing_share,
  count(value) = 0 AS all_missing, avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END) > 0.95 AS too_sparse FROM u GROUP BY col""",
    ("observations",),
)
def missing_profile(t):
    obs = t.observations().withColumn("station_d", F.col("station").cast("double"))
    return r6(qa.missing_profile(obs, ["station_d", *COLS]), "missing_share")


@query(
    "coverage_by_column",
    "SELECT col, round(count(value) / count(*)::DOUBLE, 6) AS coverage FROM (SELECT * FROM observations UNPIVOT INCLUDE NULLS (value FOR col IN (aux_1, aux_2))) GROUP BY col",
    ("observations",),
)
def coverage_by_column(t):
    return r6(qa.coverage_by_column(t.observations(), AUX), "coverage")


@query(
    "describe_targets",
    """SELECT col, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM (SELECT * FROM observations UNPIVOT (value FOR col IN (target_a, target_b, target_c))) GROUP BY col""",
    ("observations",),
)
def describe_targets(t):
    out = qa.describe_targets(t.observations(), TARGETS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "q25", "median", "q75", "max")})


@query(
    "count_locations",
    "SELECT count(*) AS n_locations FROM (SELECT DISTINCT round_even(lat, 3), round_even(lon, 3) FROM samples)",
    ("samples",),
)
def count_locations(t):
    return qa.count_locations(t.samples())


@query(
    "skew_summary",
    """SELECT col, round(skewness(value), 6) AS skew, count(*) AS n, round(median(value), 6) AS median
FROM (SELECT * FROM observations UNPIVOT (value FOR col IN (target_a, target_b, target_c))) GROUP BY col""",
    ("observations",),
)
def skew_summary(t):
    return r6(qa.skew_summary(t.observations(), TARGETS), "skew", "median")


@query(
    "normal_qq",
    """WITH o AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events),
p AS (SELECT v, CASE WHEN i = n THEN pow(5e-1, 1e0 / n) WHEN i = 1 THEN 1 - pow(5e-1, 1e0 / n) ELSE (i - 0.3175e0) / (n + 0.365e0) END AS p FROM o)
SELECT round("""
    + qa.normal_quantile_sql("p")
    + """, 6) AS theoretical, v AS ordered FROM p""",
)
def normal_qq(t):
    return r6(qa.normal_qq(t.read("events"), "value"), "theoretical")


SPEARMAN = """, u AS (SELECT a.*, b.* FROM (SELECT station, day, col AS f, value AS x FROM observations UNPIVOT (value FOR col IN ({fs}))) a
  JOIN (SELECT station AS s2, day AS d2, col AS g, value AS y FROM observations UNPIVOT (value FOR col IN ({gs}))) b ON a.station = b.s2 AND a.day = b.d2),
r AS (SELECT f, g, rank() OVER (PARTITION BY f, g ORDER BY x) + (count(*) OVER (PARTITION BY f, g, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY f, g ORDER BY y) + (count(*) OVER (PARTITION BY f, g, y) - 1) / 2e0 AS ry FROM u),
c AS (SELECT f, g, CASE WHEN count(*) >= 10 THEN corr(rx, ry) ELSE 0 END AS rho FROM r GROUP BY f, g)
"""


@query(
    "spearman_matrix",
    SPEARMAN.format(fs="aux_1, aux_2", gs="target_a, target_b, target_c")
    + """SELECT f AS feature, g AS target, round(rho, 6) AS rho, round(avg(abs(rho)) OVER (PARTITION BY f), 6) AS mean_abs_rho FROM c""",
    ("observations",),
)
def spearman_matrix(t):
    return r6(qa.spearman_matrix(t.observations(), AUX, TARGETS), "rho", "mean_abs_rho")


@query(
    "collinear_pairs",
    SPEARMAN.format(fs=ALL_COLS, gs=ALL_COLS)
    + "SELECT f AS feature_1, g AS feature_2, round(rho, 6) AS rho FROM c WHERE f < g AND abs(rho) >= 0.02",
    ("observations",),
)
def collinear_pairs(t):
    return r6(qa.collinear_pairs(t.observations(), sorted(COLS), 0.02), "rho")


@query(
    "binned_information",
    """, fl AS (SELECT station, day, coalesce(aux_1, (SELECT median(aux_1) FROM observations)) AS aux_1,
    coalesce(aux_2, (SELECT median(aux_2) FROM observations)) AS aux_2, target_a, target_b, target_c FROM observations),
u AS (SELECT a.f, b.g, a.x, b.y FROM (SELECT station, day, col AS f, value AS x FROM fl UNPIVOT (value FOR col IN (aux_1, aux_2))) a
  JOIN (SELECT station, day, col AS g, value AS y FROM fl UNPIVOT (value FOR col IN (target_a, target_b, target_c))) b USING (station, day)),
r AS (SELECT f, g, count(*) OVER (PARTITION BY f, g) AS n, rank() OVER (PARTITION BY f, g ORDER BY x) + (count(*) OVER (PARTITION BY f, g, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY f, g ORDER BY y) + (count(*) OVER (PARTITION BY f, g, y) - 1) / 2e0 AS ry FROM u),
b AS (SELECT f, g, n, floor((rx - 0.5) * 10 / n) AS bx, floor((ry - 0.5) * 10 / n) AS yb FROM r),
j AS (SELECT f, g, bx, yb, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM b GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY f, g, bx) AS cx, sum(c) OVER (PARTITION BY f, g, yb) AS cy FROM j)
SELECT f AS feature, g AS target, round(sum(c / n * ln(c * n / (cx * cy))), 6) AS mi FROM m GROUP BY f, g""",
    ("observations",),
)
def binned_information(t):
    return r6(qa.binned_information(t.observations(), AUX, TARGETS), "mi")


def _digamma(n: str) -> str:
    x = f"({n} + 6e0)"
    series = f"ln{x} - 5e-1 / {x} - (1 / 12e0 - (1 / 120e0 - (1 / 252e0 - (1 / 240e0 - 1 / 132e0 / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / ({x} * {x})"
    return f"({series} - " + " - ".join(f"1 / ({n} + {i}e0)" for i in range(6)) + ")"


@query(
    "mutual_information",
    """, fl AS (SELECT station, day, coalesce(aux_1, (SELECT median(aux_1) FROM observations)) AS aux_1,
    coalesce(aux_2, (SELECT median(aux_2) FROM observations)) AS aux_2, target_a, target_b, target_c FROM observations),
u AS (SELECT a.f, b.g, a.x, b.y FROM (SELECT station, day, col AS f, value AS x FROM fl UNPIVOT (value FOR col IN (aux_1, aux_2))) a
  JOIN (SELECT station, day, col AS g, value AS y FROM fl UNPIVOT (value FOR col IN (target_a, target_b, target_c))) b USING (station, day)),
s AS (SELECT f, g, round_even(x / stddev_pop(x) OVER w * 1073741824e0, 0) AS x, round_even(y / stddev_pop(y) OVER w * 1073741824e0, 0) AS y, count(*) OVER w AS n
  FROM u WINDOW w AS (PARTITION BY f, g)),
p AS (SELECT f, g, x, y, any_value(n) AS n, count(*) AS c FROM s GROUP BY f, g, x, y),
d AS (SELECT p.f, p.g, p.x, p.y, p.c, p.n, greatest(abs(p.x - q.x), abs(p.y - q.y)) AS d, q.c AS k FROM p JOIN p q ON p.f = q.f AND p.g = q.g),
h AS (SELECT f, g, x, y, c, n, d, sum(k) OVER (PARTITION BY f, g, x, y ORDER BY d) AS held FROM d),
r AS (SELECT f, g, x, y, any_value(c) AS c, any_value(n) AS n, greatest(min(d) - 2, 1e0) AS r FROM h WHERE held > 5 GROUP BY f, g, x, y),
m AS (SELECT r.f, r.g, r.x, r.y, any_value(r.c) AS c, any_value(r.n) AS n, CAST(sum(q.c) FILTER (abs(q.x - r.x) < r.r) AS DOUBLE) AS nx, CAST(sum(q.c) FILTER (abs(q.y - r.y) < r.r) AS DOUBLE) AS ny
  FROM r JOIN p q ON q.f = r.f AND q.g = r.g GROUP BY r.f, r.g, r.x, r.y)
SELECT f AS feature, g AS target, round(greatest(0e0, """
    + _digamma("any_value(n)") + " + " + _digamma("5e0") + " - sum(c * (" + _digamma("nx") + " + " + _digamma("ny")
    + """)) / sum(c)), 6) AS mi FROM m GROUP BY f, g""",
    ("observations",),
)
def mutual_information(t):
    return r6(qa.mutual_information(t.observations(), AUX, TARGETS), "mi")


@query(
    "grid_density",
    """SELECT CAST(floor(lon / 0.5e0) AS BIGINT) AS cx, CAST(floor(lat / 0.5e0) AS BIGINT) AS cy, count(*) AS n, round(median(target_a), 4) AS median_target_a
FROM samples GROUP BY ALL""",
    ("samples",),
)
def grid_density(t):
    out = qa.grid_density(t.samples(), "lon", "lat", 0.5, "target_a")
    return out.withColumn("median_target_a", F.round("median_target_a", 4))


@query("location_frequency", "SELECT lat, lon, count(*) AS n FROM samples GROUP BY ALL", ("samples",))
def location_frequency(t):
    return qa.location_frequency(t.samples())


@query(
    "within_location_cv",
    """SELECT round_even(lat, 3) AS lat, round_even(lon, 3) AS lon, 'target_a' AS target, round(stddev_samp(target_a) / avg(target_a), 6) AS cv
FROM samples GROUP BY 1, 2 HAVING count(target_a) >= 3 AND avg(target_a) <> 0""",
    ("samples",),
)
def within_location_cv(t):
    return r6(qa.within_location_cv(t.samples(), ["target_a"]), "cv")


ORDER_LOG = "(SELECT CAST(o_orderdate AS DATE) AS day, ln(o_totalprice) AS log_price FROM orders)"


def order_log(t):
    return t.read("orders").select(F.col("o_orderdate").cast("date").alias("day"), F.log("o_totalprice").alias("log_price"))


@query(
    "monthly_trend",
    f"""SELECT CAST(date_trunc('month', day) AS DATE) AS month, 'log_price' AS target, round(avg(log_price), 6) AS mean, round(stddev_samp(log_price), 6) AS std
FROM {ORDER_LOG} GROUP BY 1 HAVING stddev_samp(log_price) IS NOT NULL""",
)
def monthly_trend(t):
    return r6(qa.monthly_trend(order_log(t), "day", ["log_price"]), "mean", "std")


@query(
    "seasonal_quartiles",
    f"""SELECT CAST(month(day) AS INT) AS month, 'log_price' AS target, round(quantile_cont(log_price, 0.25), 6) AS q25, round(median(log_price), 6) AS median,
  round(quantile_cont(log_price, 0.75), 6) AS q75 FROM {ORDER_LOG} GROUP BY 1""",
)
def seasonal_quartiles(t):
    return r6(qa.seasonal_quartiles(order_log(t), "day", ["log_price"]), "q25", "median", "q75")


@query(
    "year_month_pivot",
    "SELECT CAST(year(day) AS INT) AS year, "
    + ", ".join(f"round(median(log_price) FILTER (month(day) = {m}), 6) AS m{m}" for m in range(1, 13))
    + f" FROM {ORDER_LOG} GROUP BY 1",
)
def year_month_pivot(t):
    return r6(qa.year_month_pivot(order_log(t), "day", "log_price"), *[f"m{m}" for m in range(1, 13)])


@query(
    "station_year_coverage",
    """WITH c AS (SELECT o_custkey AS station, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY ALL),
b AS (SELECT station, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY station ORDER BY total DESC, station LIMIT 40),
y AS (SELECT DISTINCT year FROM c JOIN b USING (station))
SELECT b.station, y.year, coalesce(c.n, 0) AS n, b.total FROM b CROSS JOIN y LEFT JOIN c ON c.station = b.station AND c.year = y.year""",
)
def station_year_coverage(t):
    rows = t.read("orders").select(F.col("o_custkey").alias("station"), F.col("o_orderdate").cast("date").alias("day"))
    return qa.station_year_coverage(rows)


@query(
    "density_histogram",
    f"""WITH v AS {ORDER_LOG}, e AS (SELECT min(log_price) AS lo, max(log_price) AS hi, count(*) AS n FROM v)
SELECT CAST(least(floor((log_price - lo) / ((hi - lo) / 60)), 59) AS INT) AS bin, round(any_value(lo) + any_value(least(floor((log_price - lo) / ((hi - lo) / 60)), 59)) * any_value((hi - lo) / 60), 6) AS left_edge,
  count(*) AS n, round(count(*) / (any_value(e.n) * any_value((hi - lo) / 60)), 6) AS density FROM v, e GROUP BY 1""",
)
def density_histogram(t):
    return r6(qa.density_histogram(order_log(t), "log_price", 60), "left_edge", "density")
