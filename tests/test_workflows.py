"""The end-to-end runs on the smallest tables."""

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from terralex.plans import workflows
from terralex.plans.adapters import AUX, Tables


def test_station_run(spark, sf_dir):
    t = Tables(spark, sf_dir)
    obs = t.observations()
    samples = t.samples().drop("target_a")
    rows = workflows.station_features(samples, t.stations(), obs, ["target_b"], AUX)
    assert rows.count() == samples.count()
    known = obs.select("station", "day", "target_a")
    train = rows.join(known, ["station", "day"], "left")
    small = {"gbt": lambda s: GBTRegressor(maxIter=2, maxDepth=2, seed=s)}
    model = workflows.train_targets(train, {"target_a": "log1p"}, small, n_folds=2)
    pred = workflows.predict_targets(model, rows)
    assert pred.filter(F.col("pred_target_a").isNull() | (F.col("pred_target_a") < 0)).count() == 0
    score = workflows.score_predictions(pred, obs, ["target_a"]).first()
    assert score["n_matched"] > 0 and score["n_matched"] + score["n_missed"] == rows.count()


def test_word_vector_run(spark, sf_dir):
    docs = Tables(spark, sf_dir).read("documents")
    vectors, losses = workflows.train_word_vectors(docs, dim=4, window=1, negatives=1, epochs=1, rounds=1)
    row = vectors.first()
    assert len(row["vec"]) == 4 and len(losses) == 1 and losses[0] > 0
