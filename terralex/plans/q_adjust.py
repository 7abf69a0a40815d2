"""Registered queries: imputation, calibration, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.operators import calibrate as cb
from terralex.operators import impute as im
from terralex.operators import profiles as pf
from terralex.operators import temporal as tp
from terralex.plans.adapters import AUX, TARGETS
from terralex.plans.q_temporal import INTERP, r6
from terralex.plans.registry import query

STATS = """, stats AS (SELECT station, avg(target_a) AS mean, stddev_samp(target_a) AS std, min(target_a) AS mn, max(target_a) AS mx
  FROM observations WHERE target_a IS NOT NULL GROUP BY station HAVING count(*) >= 5),
pooled AS (SELECT avg(target_a) AS gm, stddev_pop(target_a) AS gs FROM observations WHERE station IN (SELECT station FROM stats))
"""


def stats(t):
    obs = t.observations()
    s = pf.station_stats(obs, "target_a")
    return s, pf.pooled_stats(obs, "target_a", s)


@query(
    "station_calibrate",
    STATS
    + """SELECT p.station, p.day, round(greatest(CASE WHEN s.mean IS NULL THEN pred ELSE 0.5 * pred + 0.5 *
  least(greatest(s.mean + (pred - gm) / gs * CASE WHEN s.std < 1e-8 THEN gs ELSE s.std END, s.mn * 0.5), s.mx * 1.5) END, 0), 6) AS calibrated
FROM predictions p LEFT JOIN stats s USING (station), pooled""",
    ("predictions",),
)
def station_calibrate(t):
    out = cb.station_calibrate(t.predictions(), *stats(t))
    return r6(out.select("station", "day", "calibrated"), "calibrated")


@query(
    "variance_decompress",
    STATS
    + """, own AS (SELECT station, avg(pred) AS pm, stddev_pop(pred) AS ps FROM predictions GROUP BY station)
SELECT p.station, p.day, round(greatest(coalesce(s.mean + (pred - pm) * least(CASE WHEN s.std < 1e-8 THEN gs ELSE s.std END / greatest(ps, 1e-8), 2), pred), 0), 6) AS decompressed
FROM predictions p LEFT JOIN stats s USING (station) JOIN own USING (station), pooled""",
    ("predictions",),
)
def variance_decompress(t):
    out = cb.variance_decompress(t.predictions(), *stats(t))
    return r6(out.select("station", "day", "decompressed"), "decompressed")


@query(
    "confidence_blend",
    """, x AS (SELECT event_id, value AS g, value * 1.2e0 AS d, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN value * 2 ELSE value * 1.1e0 END AS ps,
  0.75e0 + (event_id % 25) / 1e2 AS conf FROM events),
y AS (SELECT *, g + 0.35e0 * (d - g) AS adj, least(greatest((conf - 0.8e0) * 1.5e0, 0), 0.35e0) AS a FROM x),
z AS (SELECT *, CASE WHEN ps IS NULL OR ps <= 0 THEN 0 WHEN ps / (adj + 1e-6) < 0.6 OR ps / (adj + 1e-6) > 1.6 THEN a * 0.35e0 ELSE a END AS al FROM y)
SELECT event_id, round(greatest(al * coalesce(ps, 0) + (1 - al) * adj, 0), 9) AS blended FROM z""".replace(", x AS", "WITH x AS", 1),
)
def confidence_blend(t):
    k, v = F.col("event_id") % 4, F.col("value")
    rows = t.read("events").select(
        "event_id", v.alias("g"), (v * 1.2).alias("d"),
        F.when(k == 0, F.lit(None).cast("double")).when(k == 1, v * 2).otherwise(v * 1.1).alias("ps"),
        (F.lit(0.75) + (F.col("event_id") % 25) / 100.0).alias("conf"),
    )
    mixed = cb.confidence_blend(F.col("g"), F.col("d"), F.col("ps"), F.col("conf"), "conductance")
    return rows.select("event_id", F.round(mixed, 9).alias("blended"))


@query(
    "method_blend",
    INTERP
    + """, med AS (SELECT station, median(target_a) AS m FROM observations GROUP BY station),
c AS (SELECT p.sample_id, p.station, CASE WHEN p.sample_id % 3 = 0 THEN 40e0 + p.sample_id % 11 END AS reg, CASE WHEN p.sample_id % 2 = 0 THEN 0e0 ELSE 0.6e0 END AS reg_conf,
  CASE WHEN p.sample_id % 5 <> 0 THEN i.interp END AS interp, coalesce(i.conf, 0e0) * 0.7e0 AS ic FROM placed p LEFT JOIN interp i ON i.station = p.station AND i.day = p.day),
s AS (SELECT *, (CASE WHEN reg IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN interp IS NOT NULL THEN 1 ELSE 0 END) AS n,
  (CASE WHEN reg IS NOT NULL THEN reg_conf ELSE 0 END) + (CASE WHEN interp IS NOT NULL THEN ic ELSE 0 END) AS tot FROM c)
SELECT sample_id, round(greatest(coalesce(CASE WHEN tot > 0 THEN (coalesce(reg * reg_conf, 0) + coalesce(interp * ic, 0)) / tot END,
  CASE WHEN n > 0 THEN (coalesce(reg, 0) + coalesce(interp, 0)) / n END, m, 0), 0), 7) AS blend,
  round(CASE WHEN n > 0 AND tot > 0 THEN tot / n WHEN n > 0 THEN 0.1e0 WHEN m IS NOT NULL THEN 0.2e0 ELSE 0 END, 6) AS blend_conf
FROM s LEFT JOIN med USING (station)""",
    ("observations", "placed"),
)
def method_blend(t):
    interp = tp.temporal_interpolation(t.placed(), t.observations(), "target_a", 10)
    k = F.col("sample_id")
    cands = interp.withColumns(
        {
            "reg": F.when(k % 3 == 0, F.lit(40.0) + k % 11),
            "reg_conf": F.when(k % 2 == 0, 0.0).otherwise(0.6),
            "interp": F.when(k % 5 != 0, F.col("interp")),
        }
    )
    out = cb.method_blend(cands, [("reg", "reg_conf", 1.0), ("interp", "interp_conf", 0.7)], t.observations(), "target_a")
    return out.select("sample_id", F.round("blend", 7).alias("blend"), F.round("blend_conf", 6).alias("blend_conf"))


@query(
    "group_median_impute",
    """, s AS (SELECT o.station, o.day, round_even(lat, 2) AS glat, round_even(lon, 2) AS glon, o.aux_1, o.aux_2 FROM observations o JOIN stations USING (station)),
g AS (SELECT glat, glon, median(aux_1) AS m1, median(aux_2) AS m2 FROM s GROUP BY ALL)
SELECT s.station, s.day, round(coalesce(aux_1, m1, (SELECT median(aux_1) FROM s), 0), 6) AS aux_1, round(coalesce(aux_2, m2, (SELECT median(aux_2) FROM s), 0), 6) AS aux_2
FROM s JOIN g USING (glat, glon)""",
    ("stations", "observations"),
)
def group_median_impute(t):
    keyed = t.observations().join(t.stations(), "station").select(
        "station", "day", F.bround("lat", 2).alias("glat"), F.bround("lon", 2).alias("glon"), *AUX
    )
    out = im.group_median_impute(keyed, AUX, ["glat", "glon"])
    return r6(out.select("station", "day", *AUX), *AUX)


@query(
    "median_impute",
    """SELECT station, day, round(coalesce(aux_1, (SELECT median(aux_1) FROM observations)), 6) AS aux_1,
  round(coalesce(aux_2, (SELECT median(aux_2) FROM observations)), 6) AS aux_2 FROM observations""",
    ("observations",),
)
def median_impute(t):
    return r6(im.median_impute(t.observations().select("station", "day", *AUX), AUX), *AUX)


@query("drop_sparse_columns", "SELECT station, day, target_a FROM observations", ("observations",))
def drop_sparse_columns(t):
    gone = F.when(F.col("station") < 0, 1.0)
    # About one row in a hundred at every scale.
    rare = F.when(F.pmod(F.col("station") * 31 + F.dayofyear("day"), F.lit(100)) == 3, F.col("aux_1"))
    obs = t.observations().select("station", "day", "target_a").withColumn("aux_1", F.lit(1.0))
    obs = obs.withColumns({"gone": gone, "aux_1": rare})
    return im.drop_sparse_columns(obs, ["target_a", "gone", "aux_1"])


@query("chained_regression_impute")
def chained_regression_impute(t):
    cols = ["lat", "lon", "dom", *TARGETS, *AUX]
    rows = t.observations().join(t.stations(), "station").withColumn("dom", F.dayofmonth("day").cast("double"))
    model = im.fit_chained_imputer(rows, cols)
    if not model.converged:
        raise RuntimeError(f"filled values have not settled after {model.rounds} rounds")
    return model.transform(rows).select("station", "day", *cols)
