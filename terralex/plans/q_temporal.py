"""Registered queries: lags, rolling means, as-of and nearest-in-time lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.operators import temporal as tp
from terralex.plans.adapters import AUX, TARGETS
from terralex.plans.registry import query


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "lag_last_valid",
    """SELECT station, day,
  last_value(target_a IGNORE NULLS) OVER w AS lag_target_a,
  last_value(target_b IGNORE NULLS) OVER w AS lag_target_b,
  last_value(target_c IGNORE NULLS) OVER w AS lag_target_c
FROM observations
WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ("observations",),
)
def lag_last_valid(t):
    out = tp.lag_last_valid(t.observations(), TARGETS)
    return out.select("station", "day", *[f"lag_{c}" for c in TARGETS])


@query(
    "lag_days",
    """SELECT station, day,
  date_diff('day', last_value(CASE WHEN target_a IS NOT NULL THEN day END IGNORE NULLS) OVER w, day)::INT AS lag_target_a_days,
  date_diff('day', last_value(CASE WHEN target_b IS NOT NULL THEN day END IGNORE NULLS) OVER w, day)::INT AS lag_target_b_days
FROM observations
WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ("observations",),
)
def lag_days(t):
    out = tp.lag_last_valid(t.observations(), ["target_a", "target_b"], segment_days=7)
    return out.select("station", "day", "lag_target_a_days", "lag_target_b_days")


@query(
    "lag_aux",
    """SELECT station, day, last_value(aux_1 IGNORE NULLS) OVER w AS lag_aux_1,
  last_value(aux_2 IGNORE NULLS) OVER w AS lag_aux_2
FROM observations
WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ("observations",),
)
def lag_aux(t):
    return tp.lag_last_valid(t.observations(), AUX).select("station", "day", "lag_aux_1", "lag_aux_2")


@query(
    "rolling_last_n",
    """, v AS (SELECT station, day,
    avg(target_a) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
    avg(target_a) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m5,
    avg(target_a) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m10
  FROM observations WHERE target_a IS NOT NULL)
SELECT o.station, o.day,
  round(last_value(v.m3 IGNORE NULLS) OVER w, 6) AS roll3_target_a,
  round(last_value(v.m5 IGNORE NULLS) OVER w, 6) AS roll5_target_a,
  round(last_value(v.m10 IGNORE NULLS) OVER w, 6) AS roll10_target_a
FROM observations o LEFT JOIN v USING (station, day)
WINDOW w AS (PARTITION BY o.station ORDER BY o.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ("observations",),
)
def rolling_last_n(t):
    out = tp.rolling_last_n(t.observations(), "target_a", [3, 5, 10])
    names = ["roll3_target_a", "roll5_target_a", "roll10_target_a"]
    return r6(out.select("station", "day", *names), *names)


@query(
    "asof_last",
    """SELECT p.sample_id, p.station, p.day, o.v AS asof_target_a, date_diff('day', o.day, p.day)::INT AS asof_target_a_days
FROM placed p ASOF LEFT JOIN (SELECT station, day, target_a AS v FROM observations WHERE target_a IS NOT NULL) o
  ON p.station = o.station AND p.day > o.day""",
    ("observations", "placed"),
)
def asof_last(t):
    return tp.asof_last(t.placed(), t.observations(), "target_a")


@query(
    "trailing_window_join",
    """, d AS (SELECT DISTINCT station, day FROM placed),
m AS (SELECT d.station, d.day,
    avg(CASE WHEN o.day >= d.day - 7 THEN o.target_a END) AS t7,
    avg(CASE WHEN o.day >= d.day - 90 THEN o.target_a END) AS t90,
    avg(CASE WHEN o.day >= d.day - 180 THEN o.target_a END) AS t180,
    avg(CASE WHEN o.day >= d.day - 365 THEN o.target_a END) AS t365
  FROM d JOIN observations o ON o.station = d.station AND o.day < d.day GROUP BY ALL)
SELECT p.sample_id, p.station, p.day, round(t7, 6) AS trail7_target_a, round(t90, 6) AS trail90_target_a,
  round(t180, 6) AS trail180_target_a, round(t365, 6) AS trail365_target_a
FROM placed p LEFT JOIN m ON p.station = m.station AND p.day = m.day""",
    ("observations", "placed"),
)
def trailing_window_join(t):
    sizes = [7, 90, 180, 365]
    out = tp.trailing_window_join(t.placed(), t.observations(), "target_a", sizes)
    return r6(out, *[f"trail{n}_target_a" for n in sizes])


HISTORY = """, ranked AS (SELECT p.station, p.day, o.day AS oday, o.target_a, o.aux_1,
    row_number() OVER (PARTITION BY p.station, p.day ORDER BY o.day DESC) AS rn
  FROM (SELECT DISTINCT station, day FROM placed) p JOIN observations o ON o.station = p.station AND o.day < p.day),
kept AS (SELECT * FROM ranked WHERE rn <= {n}),
seqs AS (SELECT station, day, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 2)
"""


@query(
    "history_sequences",
    HISTORY.format(n=24)
    + """, steps AS (SELECT k.* FROM kept k JOIN seqs USING (station, day)),
summed AS (SELECT station, day, count(*) AS length, min(oday) AS first_day, max(oday) AS last_day,
    round(sum(target_a), 4) AS target_sum, count(target_a) AS target_n,
    round(sum(sin(2 * pi() * month(oday) / 12) + cos(2 * pi() * dayofyear(oday) / 365.25)), 6) AS cyclic_sum
  FROM steps GROUP BY ALL)
SELECT p.sample_id, s.length, s.first_day, s.last_day, s.target_sum, s.target_n, s.cyclic_sum
FROM placed p LEFT JOIN summed s ON p.station = s.station AND p.day = s.day""",
    ("observations", "placed"),
)
def history_sequences(t):
    seq = tp.history_sequences(t.placed(), t.observations(), ["target_a", "aux_1"], 24)
    s = F.col("sequence")
    total = lambda f: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + f(x))
    valued = F.size(F.filter(s, lambda x: x["target_a"].isNotNull()))
    return seq.select(
        "sample_id",
        F.when(s.isNotNull(), F.size(s)).cast("bigint").alias("length"),
        s[0]["date"].alias("first_day"),
        F.element_at(s, -1)["date"].alias("last_day"),
        F.when(valued > 0, F.round(total(lambda x: F.coalesce(x["target_a"], F.lit(0.0))), 4)).alias("target_sum"),
        F.when(s.isNotNull(), valued).cast("bigint").alias("target_n"),
        F.round(total(lambda x: x["month_sin"] + x["doy_cos"]), 6).alias("cyclic_sum"),
    )


@query(
    "sequence_normalize",
    HISTORY.format(n=24)
    + """, steps AS (SELECT p.sample_id, k.rn, k.target_a, k.aux_1 FROM placed p JOIN seqs s USING (station, day)
    JOIN kept k ON k.station = p.station AND k.day = p.day),
st AS (SELECT avg(target_a) AS ma, stddev_pop(target_a) AS sa, avg(aux_1) AS m1, stddev_pop(aux_1) AS s1 FROM steps)
SELECT sample_id, count(*) AS length, CAST(24 AS BIGINT) AS padded,
  round(sum(coalesce((target_a - ma) / sa, 0)), 5) AS target_sum, round(sum(coalesce((aux_1 - m1) / s1, 0)), 5) AS aux_sum
FROM steps, st GROUP BY sample_id""",
    ("observations", "placed"),
)
def sequence_normalize(t):
    cols = ["target_a", "aux_1"]
    seq = tp.history_sequences(t.placed(), t.observations(), cols, 24).filter(F.col("sequence").isNotNull())
    out = tp.sequence_normalize(seq, cols, 24)
    total = lambda i: F.aggregate("normalized", F.lit(0.0), lambda acc, x: acc + x[i])
    return out.select(
        "sample_id",
        F.col("length").cast("bigint").alias("length"),
        F.size("normalized").cast("bigint").alias("padded"),
        F.round(total(0), 5).alias("target_sum"),
        F.round(total(1), 5).alias("aux_sum"),
    )


def _with_aux(t):
    """Samples whose aux columns come from the same day's row where the key is even, else null."""
    even = F.when(F.col("sample_id") % 2 == 0, F.lit(1.5))
    return t.placed().withColumns({"aux_1": even, "aux_2": F.lit(None).cast("double")})


AUX_SAMPLES = """, aux_samples AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 1.5e0 END AS aux_1,
  CAST(NULL AS DOUBLE) AS aux_2 FROM placed)
"""


@query(
    "sameday_lookup",
    AUX_SAMPLES
    + """SELECT s.sample_id, s.station, s.day, coalesce(s.aux_1, o.aux_1) AS aux_1, coalesce(s.aux_2, o.aux_2) AS aux_2
FROM aux_samples s LEFT JOIN observations o ON s.station = o.station AND s.day = o.day""",
    ("observations", "placed"),
)
def sameday_lookup(t):
    return tp.sameday_lookup(_with_aux(t), t.observations(), AUX, ["day"])


@query(
    "nearest_date_fill",
    AUX_SAMPLES
    + """, near AS (SELECT d.station, d.day, o.aux_1, o.aux_2
  FROM (SELECT DISTINCT station, day FROM placed) d JOIN observations o
    ON o.station = d.station AND o.day BETWEEN d.day - 30 AND d.day + 30
  QUALIFY row_number() OVER (PARTITION BY d.station, d.day ORDER BY abs(date_diff('day', d.day, o.day)), o.day) = 1)
SELECT s.sample_id, s.station, s.day,
  CASE WHEN s.aux_1 IS NULL AND s.aux_2 IS NULL THEN n.aux_1 ELSE s.aux_1 END AS aux_1,
  CASE WHEN s.aux_1 IS NULL AND s.aux_2 IS NULL THEN n.aux_2 ELSE s.aux_2 END AS aux_2
FROM aux_samples s LEFT JOIN near n ON s.station = n.station AND s.day = n.day""",
    ("observations", "placed"),
)
def nearest_date_fill(t):
    return tp.nearest_date_fill(_with_aux(t), t.observations(), AUX)


INTERP = """, ranked AS (SELECT d.station, d.day, o.target_a AS v, abs(date_diff('day', d.day, o.day)) AS gap,
    row_number() OVER (PARTITION BY d.station, d.day ORDER BY abs(date_diff('day', d.day, o.day)), o.day) AS rn
  FROM (SELECT DISTINCT station, day FROM placed) d JOIN observations o
    ON o.station = d.station AND o.day <> d.day AND o.target_a IS NOT NULL),
interp AS (SELECT station, day, sum(v / (gap + 1e0)) / sum(1e0 / (gap + 1e0)) AS interp,
    CASE WHEN min(gap) <= 7 THEN 0.95e0 WHEN min(gap) <= 30 THEN 0.85e0 WHEN min(gap) <= 90 THEN 0.6e0
      WHEN min(gap) <= 180 THEN 0.35e0 ELSE 0.15e0 END AS conf
  FROM ranked WHERE rn <= 10 GROUP BY ALL)
"""


@query(
    "temporal_interpolation",
    INTERP
    + """SELECT p.sample_id, p.station, p.day, round(i.interp, 7) AS interp, coalesce(i.conf, 0e0) AS interp_conf
FROM placed p LEFT JOIN interp i ON p.station = i.station AND p.day = i.day""",
    ("observations", "placed"),
)
def temporal_interpolation(t):
    out = tp.temporal_interpolation(t.placed(), t.observations(), "target_a", 10)
    return out.withColumn("interp", F.round("interp", 7))
