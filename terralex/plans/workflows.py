"""End-to-end runs: features, stacked models and predictions for stations; vectors for a corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions.scalars import calendar_features, coverage_flag, target_inverse, target_transform
from terralex.operators import embed, learn, metrics, profiles, spatial, temporal, text
from terralex.session import cut_lineage

KEY = "sample_id"


def station_features(
    samples: DataFrame, stations: DataFrame, obs: DataFrame, targets: Sequence[str], aux: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Everything known about a sample before its day, from its own and neighbouring stations.

    ``samples`` has (sample_id, lat, lon, day), ``obs`` rows per station and day, as the reader of station
    files gives them. Several rows of a day come by ``order``, by default by ``date``; without both a day
    has one row.
    """
    order = temporal.row_order(obs, order) or ["day"]
    none = {c: F.lit(None).cast("double") for c in aux if c not in samples.columns}
    out = spatial.coord_to_station(samples, stations).withColumns(none)
    out = temporal.sameday_lookup(out, obs, aux, order)
    out = temporal.nearest_date_fill(out, obs, aux, order=order)
    # Each fill reads its input more than once.
    out = cut_lineage(spatial.nearest_station_fill(out, stations, obs, aux, order=order))
    for t in targets:
        out = temporal.asof_last(out, obs, t, order=order)
        out = temporal.trailing_window_join(out, obs, t, [90, 180, 365])
    out = spatial.neighbor_idw(out, stations, obs, targets, order=order)
    out = calendar_features(out, "day")
    return cut_lineage(coverage_flag(coverage_flag(out, "aux_", "has_aux"), "asof_", "has_lag"))


def feature_names(df: DataFrame, targets: Sequence[str]) -> list[str]:
    from terralex.functions.scalars import select_features

    return select_features(df, drop=[KEY, "station", *targets])


@dataclass
class TargetModels:
    features: list[str]
    models: dict[str, learn.StackedModel]
    transforms: dict[str, str]


def train_targets(
    rows: DataFrame, targets: Mapping[str, str], estimators: Mapping[str, learn.Factory] | None = None, n_folds: int = 5
) -> TargetModels:
    """A stacked model per target, folds by station (or rounded coordinate).

    ``targets`` gives each target's transform. Labels are clipped to their 1 % and 99 % quantiles.
    """
    features = feature_names(rows, list(targets))
    group = F.coalesce(
        F.col("station").cast("string"), F.concat_ws("_", F.bround("lat", 2).cast("string"), F.bround("lon", 2).cast("string"))
    )
    models = {}
    for t, method in targets.items():
        known = rows.filter(F.col(t).isNotNull()).withColumn("_group", group)
        known = profiles.winsorize(known, t).withColumn("_label", target_transform(F.col(t), method))
        data = cut_lineage(learn.group_kfold(known, "_group", n_folds))
        models[t], _ = learn.fit_stacked(data, features, "_label", estimators, n_folds)
    return TargetModels(features, models, dict(targets))


def predict_targets(model: TargetModels, rows: DataFrame) -> DataFrame:
    out = rows
    for t, m in model.models.items():
        raw = m.predict(out, f"_raw_{t}")
        back = F.greatest(target_inverse(F.col(f"_raw_{t}"), model.transforms[t]), F.lit(0.0))
        out = raw.withColumn(f"pred_{t}", back).drop(f"_raw_{t}")
    return out


def score_predictions(pred: DataFrame, obs: DataFrame, targets: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Scores per target against the first history row of the same station and day."""
    out, order = None, temporal.row_order(obs, order) or ["day"]
    for t in targets:
        matched = metrics.score_match(pred.select("station", "day", F.col(f"pred_{t}").alias("pred")), obs, t, order)
        part = matched.select(F.lit(t).alias("target"), "truth", "pred")
        out = part if out is None else out.unionByName(part)
    return metrics.regression_metrics(out, by=["target"])


def train_word_vectors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 200, window: int = 6, negatives: int = 10,
    epochs: int = 20, rounds: int = 50, min_count: int = text.MIN_COUNT, max_vocab: int = text.MAX_VOCAB, seed: int = 42,
    scope: str = "corpus",
) -> tuple[DataFrame, list[float]]:
    """(word_id, word, vec) and the loss of each epoch."""
    tokens = text.tokenize(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    words = cut_lineage(text.vocab(tokens, max_vocab, min_count))
    if words.isEmpty():
        raise ValueError("the vocabulary is empty; lower min_count or use more text")
    thin = cut_lineage(text.subsample(text.encode(tokens, words), seed=seed))
    placed = cut_lineage(text.renumber(thin, scope))
    pairs = lambda epoch: text.skipgram_pairs(placed, window, f"{seed}.{epoch}", scope)
    emb, losses = embed.train(pairs, text.negative_slots(words), words, dim, negatives, epochs, rounds, seed=seed, word_cap=4)
    return embed.embedding_sum(emb).join(words.select("word_id", "word"), "word_id").select("word_id", "word", "vec"), losses
