"""Registered queries: splits, stacked models, diagnosis, per-station regressions."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from terralex.operators import learn as le
from terralex.operators import temporal as tp
from terralex.plans.adapters import AUX
from terralex.plans.registry import query
from terralex.session import cut_lineage

FEATURES = ["lat", "lon", "dom", "lag_target_a", "lag_target_b", *AUX]
FOLDS = 5
LEARNERS = le.default_estimators()
#: Folds and draws of the registered queries with very many fits.
FEW_FOLDS = 3
TRIALS = 3


def features(t):
    """Labelled station-days with coordinates and lags, written once: many fits read them."""
    lagged = tp.lag_last_valid(t.observations(), ["target_a", "target_b"])
    rows = lagged.join(t.stations(), "station").withColumns(
        {"dom": F.dayofmonth("day").cast("double"), "row_id": F.col("station") * 100_000 + F.unix_date("day")}
    )
    return rows


def labelled(t, folds=FOLDS):
    rows = features(t).filter(F.col("target_a").isNotNull())
    return cut_lineage(le.group_kfold(rows, "station", folds) if folds else rows)


@query(
    "group_kfold",
    """WITH RECURSIVE s AS (SELECT user_id, count(*) AS n, concat('0x', substr(md5(concat('42:', user_id)), 1, 8))::BIGINT / 4294967296.0 AS u FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, u, user_id) AS r, row_number() OVER (PARTITION BY n ORDER BY u, user_id) AS p FROM s),
g AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT r.r, r.n, list_position(loads, list_min(loads)),
    list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + r.n ELSE v END) FROM g JOIN r ON r.r = g.r + 1),
f AS (SELECT n, fold - 1 AS fold, row_number() OVER (PARTITION BY n ORDER BY fold) AS p FROM g WHERE r > 0)
SELECT e.event_id, e.user_id, CAST(f.fold AS INT) AS fold FROM events e JOIN r USING (user_id) JOIN f ON f.n = r.n AND f.p = r.p""",
)
def group_kfold(t):
    return le.group_kfold(t.read("events").select("event_id", "user_id"), "user_id", 5)


@query(
    "temporal_holdout",
    """WITH w AS (SELECT event_id, user_id, row_number() OVER (ORDER BY CAST(ts AS DATE), event_id) AS ra, count(*) OVER () AS na,
  row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS rs, count(*) OVER (PARTITION BY user_id) AS ns FROM events)
SELECT event_id, ra <= floor(na * 0.8e0) AS train_all, rs <= floor(ns * 0.8e0) AS train_station FROM w""",
)
def temporal_holdout(t):
    rows = t.read("events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    whole = le.temporal_holdout(rows, "day", "event_id").withColumnRenamed("is_train", "train_all")
    per = le.temporal_holdout(whole, "day", "event_id", by=["user_id"]).withColumnRenamed("is_train", "train_station")
    return per.select("event_id", "train_all", "train_station")


@query("oof_predictions")
def oof_predictions(t):
    oof, _ = le.oof_predictions(labelled(t), FEATURES, "target_a", LEARNERS, FOLDS)
    return oof.select("row_id", "fold", "target_a", *[f"pred_{n}" for n in LEARNERS])


@query("stacking_ensemble")
def stacking_ensemble(t):
    model, oof = le.fit_stacked(labelled(t), FEATURES, "target_a", LEARNERS, FOLDS)
    return model.predict(features(t)).select("row_id", "pred")


@query("multi_seed_ensemble")
def multi_seed_ensemble(t):
    return le.multi_seed_predict(labelled(t, FEW_FOLDS), features(t), FEATURES, "target_a", LEARNERS, FEW_FOLDS).select("row_id", "pred")


@query("leave_group_out_eval")
def leave_group_out_eval(t):
    return le.leave_group_out_eval(labelled(t, FEW_FOLDS), FEATURES, ["aux_1"], "target_a", "row_id", "station", FEW_FOLDS, LEARNERS, transform="log1p")


@query("target_chaining")
def target_chaining(t):
    rows = cut_lineage(le.group_kfold(features(t), "station", FEW_FOLDS))
    out, _ = le.target_chaining(rows, ["lat", "lon", "dom", *AUX], ["target_b", "target_a"], "row_id", FEW_FOLDS, LEARNERS["gbt"])
    return out.select("row_id", "chain_target_b", "chain_target_a")


@query("gain_pruning")
def gain_pruning(t):
    rows = labelled(t, folds=0).withColumn("fixed", F.lit(1.0))
    kept = le.gain_pruning(rows, [*FEATURES, "fixed"], "target_a", min_features=30)
    return rows.select("row_id", *kept)


@query("hyperparameter_search")
def hyperparameter_search(t):
    make = lambda **p: GBTRegressor(seed=42, **p)
    space = {"maxIter": [5, 10, 20], "maxDepth": [2, 3, 4, 5], "stepSize": [0.05, 0.1, 0.3]}
    rows = labelled(t, folds=0).withColumn("log_a", F.log1p("target_a"))
    return le.hyperparameter_search(rows, FEATURES, "log_a", "station", make, space, trials=TRIALS, inverse=F.expm1)


@query("adversarial_validation")
def adversarial_validation(t):
    rows = cut_lineage(features(t))
    early = F.col("day") < F.lit("2024-01-21").cast("date")
    scored, auc, _ = le.adversarial_validation(rows.filter(early), rows.filter(~early), FEATURES, "row_id")
    weighted = le.adversarial_weights(rows.filter(early).withColumn("weight", F.lit(1.0)), scored, "row_id", auc)
    return weighted.select("row_id", "weight", F.lit(auc).alias("auc"))


@query("rf_modellability")
def rf_modellability(t):
    rows = cut_lineage(features(t))
    return le.rf_modellability(rows, FEATURES, ["target_a", "target_b"], "station", FEW_FOLDS, trees=20, depth=8)


@query("permutation_importance")
def permutation_importance(t):
    rows = labelled(t, folds=0)
    fitted = LEARNERS["gbt"](42).setFeaturesCol(le.VECTOR).setLabelCol("target_a").fit(le.assemble(rows, FEATURES))
    return le.permutation_importance(fitted, rows, FEATURES, "target_a", "row_id")


@query("pca_projection")
def pca_projection(t):
    out, _ = le.pca_projection(features(t), FEATURES, "row_id")
    return out


def order_history(t):
    """A dense history with complete auxiliaries: orders per customer group and day."""
    o = t.read("orders")
    return (
        o.select((F.col("o_custkey") % 150).alias("station"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_totalprice")
        .join(t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("qty"), F.avg("l_discount").cast("double").alias("disc")), "o_orderkey")
        .groupBy("station", "day")
        .agg(F.sum("o_totalprice").alias("y"), F.sum("qty").alias("aux_1"), F.avg("disc").alias("aux_2"))
    )


@query("station_ridge")
def station_ridge(t):
    hist = order_history(t)
    asked = hist.select("station", "day", F.col("y").alias("truth"))
    return le.station_ridge(asked, hist, "y", ["aux_1", "aux_2"])


@query("station_boosting")
def station_boosting(t):
    hist = cut_lineage(order_history(t))
    asked = hist.select("station", "day", F.col("y").alias("truth"))
    return le.station_boosting(asked, hist, "y", ["aux_1", "aux_2"])
