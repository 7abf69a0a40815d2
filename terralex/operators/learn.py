"""Grouped cross-validation, stacked models and per-station regressions.

Tree and linear learners are ``spark.ml`` estimators. Loops on the driver run over folds, seeds,
targets or trials, never over rows or groups.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.functions.scalars import hash_uniform, sanitize, target_inverse, target_transform, year_fraction
from terralex.operators.impute import Moments, linear, median_impute, moments, ridge
from terralex.operators.metrics import regression_metrics, roc_auc
from terralex.operators.quantiles import with_facts
from terralex.operators.scan import block_segment, dense_position, numbered
from terralex.operators.spatial import fold_neighbours, neighbour_means, seen_neighbours
from terralex.session import cut_lineage, ship_code

Factory = Callable[[int], object]
VECTOR = "_features"


def default_estimators(trees: int = 20, depth: int = 5) -> dict[str, Factory]:
    """Base learners by name, each made from a seed."""
    return {
        "gbt": lambda s: GBTRegressor(maxIter=trees, maxDepth=min(depth, 4), stepSize=0.1, subsamplingRate=0.8, seed=s),
        "forest": lambda s: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=s),
        "ridge": lambda s: LinearRegression(regParam=0.1, elasticNetParam=0.0),
    }


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector; what is missing or infinite counts as 0."""
    clean = {f"_x_{f}": sanitize(F.col(f).cast("double"), fill_missing=True) for f in features}
    out = VectorAssembler(inputCols=list(clean), outputCol=VECTOR).transform(df.withColumns(clean))
    return out.drop(*clean)


# --- splits ----------------------------------------------------------------------------------


def deal(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of some groups of one size each fold gets if every group in turn goes to the lightest fold, the
    first of equals. ``loads`` is raised accordingly.

    Fold f takes groups at loads L, L + size, ..; of all these the ``groups`` smallest are taken, so a load
    below which few enough lie is searched for, and one round deals out the rest.
    """
    n = len(loads)
    taken = lambda level: [max(0, -(-(level - load) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * groups + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(taken(middle)) <= groups else (low, middle)
    out = taken(low)
    # All that is left lies at this one load, in the folds' order.
    left = groups - sum(out)
    for f in range(n):
        if left and loads[f] + out[f] * size == low:
            out[f], left = out[f] + 1, left - 1
    for f in range(n):
        loads[f] += out[f] * size
    return out


def group_kfold(df: DataFrame, group: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: groups stay whole, and from the largest down each goes to the fold with the fewest rows.

    Groups of one size are dealt at once: only how many of them a fold gets has to be known, and a hash says
    which. Sizes that occur are few (m of them need more than m²/2 rows), so they are dealt on the driver;
    groups are numbered in Spark. With fewer groups than folds every group is a fold.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_u", hash_uniform(seed, F.col(group)))
    placed = numbered(sizes.withColumn("_smaller", -F.col("_n")), ["_smaller", "_u", group], "_pos")
    classes = sorted(((r["_n"], r["_c"]) for r in placed.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).collect()), reverse=True)
    loads = [0] * max(1, min(n, sum(c for _, c in classes)))
    rows, start = [], 0
    for size, groups in classes:
        ends = [start + int(v) for v in np.cumsum(deal(loads, size, groups))]
        rows.append((size, ends))
        start += groups
    ends = df.sparkSession.createDataFrame(rows, "_n long, _ends array<long>")
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_pos"))).alias("fold")
    return df.join(placed.join(ends, "_n").select(group, fold), group)


def temporal_holdout(df: DataFrame, day: str, id_col: str, share: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Add ``is_train``: the first share of rows by (day, id), over everything or per group."""
    keys = list(by)
    if keys:
        segment = F.struct(F.unix_date(F.col(day).cast("date")).alias("d"), block_segment(F.col(id_col), 65_536).alias("b"))
        placed = dense_position(df, keys, [day, id_col], segment, "_holdout_pos")
    else:
        placed = numbered(df, [day, id_col], "_holdout_pos")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_holdout_n"))
    out = with_facts(placed, sizes, keys).withColumn("is_train", F.col("_holdout_pos") < F.floor(F.col("_holdout_n") * F.lit(float(share))))
    return out.drop("_holdout_pos", "_holdout_n")


# --- out-of-fold predictions and stacking ----------------------------------------------------


@dataclass
class FoldModels:
    features: list[str]
    models: dict[str, list]

    def predict(self, df: DataFrame) -> DataFrame:
        """Mean prediction of each learner's fold models, as ``pred_<name>``."""
        out = assemble(df, self.features)
        for name, fitted in self.models.items():
            parts = []
            for i, m in enumerate(fitted):
                out = m.copy().setPredictionCol(f"_p_{name}_{i}").transform(out)
                parts.append(f"_p_{name}_{i}")
            mean = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
            out = out.withColumn(f"pred_{name}", mean).drop(*parts)
        return out.drop(VECTOR)


def oof_predictions(
    df: DataFrame, features: Sequence[str], label: str, estimators: Mapping[str, Factory], n_folds: int,
    weight: str | None = None, seed: int = 42,
) -> tuple[DataFrame, FoldModels]:
    """Every row predicted by models that saw none of its fold (column ``fold``)."""
    data = assemble(df, features)
    out, models = None, {name: [] for name in estimators}
    for f in range(n_folds):
        train, held = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        for name, make in estimators.items():
            est = make(seed).setFeaturesCol(VECTOR).setLabelCol(label)
            if weight:
                est = est.setWeightCol(weight)
            fitted = est.fit(train)
            models[name].append(fitted)
            held = fitted.copy().setPredictionCol(f"pred_{name}").transform(held)
        out = held if out is None else out.unionByName(held)
    return out.drop(VECTOR), FoldModels(list(features), models)


# Ridge strengths tried by the second level.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def _scaled(m: Moments) -> tuple[Moments, np.ndarray]:
    spread = np.sqrt(np.maximum(np.diag(m.xx) / m.n, 0.0))
    spread[spread == 0] = 1.0
    return Moments(m.n, m.x_mean / spread, m.y_mean, m.xx / np.outer(spread, spread), m.xy / spread, m.yy), spread


def _error(m: Moments, coef: np.ndarray, intercept: float) -> float:
    """Squared error of a linear fit on the rows behind some moments."""
    off = m.y_mean - intercept - coef @ m.x_mean
    return float(m.yy - 2 * coef @ m.xy + coef @ m.xx @ coef + m.n * off * off)


@dataclass
class Stack:
    cols: list[str]
    coef: np.ndarray | None
    intercept: float

    def column(self) -> Column:
        if self.coef is None:
            return sum((F.col(c) for c in self.cols[1:]), F.col(self.cols[0])) / len(self.cols)
        return linear(self.cols, self.coef, self.intercept)

    def weights(self) -> dict[str, float]:
        if self.coef is None:
            return {c: 1.0 / len(self.cols) for c in self.cols}
        total = np.abs(self.coef).sum() + 1e-10
        return {c: float(b / total) for c, b in zip(self.cols, self.coef)}


def fit_stack(oof: DataFrame, cols: Sequence[str], label: str, n_folds: int) -> Stack:
    """Ridge on the standardised level-one predictions, its strength chosen across the folds.

    Needs 20 rows, otherwise the plain mean is used. Each fit comes from one aggregation.
    """
    cols = list(cols)
    rough = {c: float(v or 0.0) for c, v in oof.agg(*[F.avg(c).alias(c) for c in (*cols, label)]).first().asDict().items()}
    whole = moments(oof, cols, label, rough)
    if whole is None or whole.n < 20:
        return Stack(cols, None, 0.0)
    errors = dict.fromkeys(ALPHAS, 0.0)
    for f in range(n_folds):
        seen = moments(oof.filter(F.col("fold") != f), cols, label, rough)
        held = moments(oof.filter(F.col("fold") == f), cols, label, rough)
        if seen is None or held is None:
            continue
        scaled, spread = _scaled(seen)
        for a in ALPHAS:
            coef, intercept = ridge(scaled, a)
            errors[a] += _error(held, coef / spread, intercept)
    scaled, spread = _scaled(whole)
    coef, intercept = ridge(scaled, min(errors, key=errors.get))
    return Stack(cols, coef / spread, intercept)


@dataclass
class StackedModel:
    folds: FoldModels
    stack: Stack

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        out = self.folds.predict(df).withColumn(name, F.greatest(self.stack.column(), F.lit(0.0)))
        return out.drop(*self.stack.cols)


def fit_stacked(
    df: DataFrame, features: Sequence[str], label: str, estimators: Mapping[str, Factory] | None = None, n_folds: int = 5,
    weight: str | None = None, seed: int = 42,
) -> tuple[StackedModel, DataFrame]:
    """Two levels over a frame with a ``fold`` column; also returns the level-one predictions."""
    estimators = estimators or default_estimators()
    oof, models = oof_predictions(df, features, label, estimators, n_folds, weight, seed)
    oof = cut_lineage(oof)
    stack = fit_stack(oof, [f"pred_{n}" for n in estimators], label, n_folds)
    return StackedModel(models, stack), oof.withColumn("pred", F.greatest(stack.column(), F.lit(0.0)))


def multi_seed_predict(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, estimators: Mapping[str, Factory] | None = None,
    n_folds: int = 5, n_seeds: int = 3,
) -> DataFrame:
    """Mean prediction of stacked models fitted with seeds 42, 1042, …"""
    out, names = test, []
    for i in range(n_seeds):
        model, _ = fit_stacked(train, features, label, estimators, n_folds, seed=42 + 1000 * i)
        out = model.predict(out, f"_seed_{i}")
        names.append(f"_seed_{i}")
    mean = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
    return out.withColumn("pred", mean).drop(*names)


def leave_group_out_eval(
    df: DataFrame, features: Sequence[str], knn_cols: Sequence[str], label: str, id_col: str, group: str, n_folds: int = 5,
    estimators: Mapping[str, Factory] | None = None, ks: Sequence[int] = (5, 10), transform: str | None = None, inner_folds: int = 3,
) -> DataFrame:
    """Scores per fold of a stacked model on the training and the held-out rows (column ``fold``).

    Neighbour features see each fold's training rows only. One search finds every row's neighbours in every
    fold, and a fold merges those it may see. The model is stacked over inner folds by ``group``; predictions
    are clipped to 0 and twice the largest training label. ``transform`` names the label's transform.
    """
    names = list(neighbour_means(F.col("_nb"), knn_cols, ks))
    base = cut_lineage(fold_neighbours(df, id_col, knn_cols, max(ks), n_folds, name="_by_fold").withColumnRenamed("fold", "_outer"))
    there = lambda c: target_transform(F.col(c), transform) if transform else F.col(c)
    back = lambda c: target_inverse(F.col(c), transform) if transform else F.col(c)
    parts = None
    for f in range(n_folds):
        rows = base.withColumn("_nb", seen_neighbours("_by_fold", f, id_col)).withColumns(neighbour_means(F.col("_nb"), knn_cols, ks))
        rows = rows.drop("_nb", "_by_fold").withColumn("_label", there(label))
        train = cut_lineage(group_kfold(rows.filter(F.col("_outer") != f), group, inner_folds))
        top = train.agg(F.max(label).cast("double")).first()[0]
        if top is None:
            continue
        found = train.agg(F.max("fold")).first()[0] + 1
        model, _ = fit_stacked(train, [*features, *names], "_label", estimators, found)
        for name, part in (("train", train.drop("fold")), ("held_out", rows.filter(F.col("_outer") == f))):
            guess = F.least(F.greatest(back("_raw"), F.lit(0.0)), F.lit(2.0 * top))
            scored = model.predict(part, "_raw").select(F.lit(f).alias("fold"), F.lit(name).alias("part"), F.col(label).alias("truth"), guess.alias("pred"))
            parts = scored if parts is None else parts.unionByName(scored)
    if parts is None:
        return df.sparkSession.createDataFrame([], "fold int, part string, r2 double, rmse double, mae double, n_matched long")
    return regression_metrics(parts, by=["fold", "part"]).select("fold", "part", "r2", "rmse", "mae", "n_matched")


@dataclass
class TargetChain:
    """Models of several targets, each with the predictions of those before it among its features."""

    order: list[str]
    models: dict[str, FoldModels]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``chain_<target>`` to rows the models have not seen."""
        out = df
        for target in self.order:
            out = self.models[target].predict(out).withColumnRenamed("pred_chain", f"chain_{target}")
        return out


def target_chaining(
    df: DataFrame, features: Sequence[str], order: Sequence[str], id_col: str, n_folds: int, estimator: Factory
) -> tuple[DataFrame, TargetChain]:
    """Predict the targets in order; each one's out-of-fold prediction is a feature of the next.

    Returns the rows with ``chain_<target>`` columns and the models, which chain new rows.
    """
    out, used, chain = df, list(features), TargetChain(list(order), {})
    for target in order:
        labelled = out.filter(F.col(target).isNotNull())
        oof, models = oof_predictions(labelled, used, target, {"chain": estimator}, n_folds)
        seen = oof.select(id_col, F.col("pred_chain").alias("_oof"))
        # Rows without the target get the mean of the fold models.
        guessed = models.predict(out).join(seen, id_col, "left")
        name = f"chain_{target}"
        out = cut_lineage(guessed.withColumn(name, F.coalesce("_oof", "pred_chain")).drop("_oof", "pred_chain"))
        used.append(name)
        chain.models[target] = models
    return out, chain


# --- selection and diagnosis -----------------------------------------------------------------


def gain_pruning(df: DataFrame, features: Sequence[str], label: str, min_features: int = 30, seed: int = 42) -> list[str]:
    """Features a boosted model uses, filled up from the rest to the minimum."""
    fitted = GBTRegressor(featuresCol=VECTOR, labelCol=label, maxIter=20, maxDepth=4, seed=seed).fit(assemble(df, features))
    gain = dict(zip(features, fitted.featureImportances.toArray()))
    kept = [f for f in features if gain[f] > 0]
    spare = [f for f in features if gain[f] <= 0]
    return kept + spare[: max(0, min_features - len(kept))]


def cap_by_groups(df: DataFrame, group: str, max_rows: int, seed: int = 42) -> DataFrame:
    """About ``max_rows`` rows as whole groups, for searches; smaller tables are kept as they are."""
    n = df.count()
    return df if n <= max_rows else df.filter(hash_uniform(seed, F.col(group)) < max_rows / n)


def hyperparameter_search(
    df: DataFrame, features: Sequence[str], label: str, group: str, make: Callable[..., object],
    space: Mapping[str, Sequence], trials: int, n_folds: int = 3, max_rows: int | None = None, seed: int = 42,
    inverse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Random search over grouped folds, scored by R² in real units, best first.

    ``space`` lists each parameter's values; ``inverse`` takes label and prediction back. All rows are
    searched on unless ``max_rows`` asks for about so many, as whole groups.
    """
    draw = random.Random(seed)
    inverse = inverse or (lambda c: c)
    rows = df if max_rows is None else cap_by_groups(df, group, max_rows, seed)
    data = cut_lineage(group_kfold(rows, group, n_folds))
    results = []
    for t in range(trials):
        params = {k: draw.choice(list(v)) for k, v in space.items()}
        oof, _ = oof_predictions(data, features, label, {"trial": lambda s, p=params: make(**p)}, n_folds)
        scored = oof.select(inverse(F.col(label)).alias("truth"), inverse(F.col("pred_trial")).alias("pred"))
        r2 = regression_metrics(scored).first()["r2"]
        results.append((t, str(sorted(params.items())), float(r2) if r2 is not None else None))
    found = df.sparkSession.createDataFrame(results, "trial int, params string, r2 double")
    return found.orderBy(F.desc_nulls_last("r2"), "trial")


def adversarial_validation(
    train: DataFrame, test: DataFrame, features: Sequence[str], id_col: str, n_folds: int = 3, seed: int = 42, trees: int = 10
) -> tuple[DataFrame, float, dict[str, float]]:
    """How well a classifier tells test from training rows: out-of-fold probabilities, AUC, importances.

    Fewer than five shared features: no model, AUC 0.5.
    """
    shared = [f for f in features if f in train.columns and f in test.columns]
    rows = train.select(id_col, *shared).withColumn("is_test", F.lit(0)).unionByName(
        test.select(id_col, *shared).withColumn("is_test", F.lit(1))
    )
    if len(shared) < 5:
        return rows.withColumn("p_test", F.lit(None).cast("double")), 0.5, {}
    fold = F.floor(hash_uniform(seed, F.col("is_test"), F.col(id_col)) * n_folds).cast("int")
    data = cut_lineage(assemble(rows.withColumn("fold", fold), shared))
    make = lambda: GBTClassifier(featuresCol=VECTOR, labelCol="is_test", maxIter=trees, maxDepth=3, stepSize=0.1, subsamplingRate=0.7, seed=seed)
    out = None
    for f in range(n_folds):
        scored = make().fit(data.filter(F.col("fold") != f)).transform(data.filter(F.col("fold") == f))
        part = scored.withColumn("p_test", vector_to_array("probability")[1]).select(id_col, "is_test", "fold", "p_test")
        out = part if out is None else out.unionByName(part)
    out = cut_lineage(out)
    auc = roc_auc(out, "is_test", "p_test").first()["auc"]
    gain = make().fit(data).featureImportances.toArray()
    return out, 0.5 if auc is None else float(auc), dict(sorted(zip(shared, map(float, gain)), key=lambda p: -p[1]))


def adversarial_weights(train: DataFrame, scored: DataFrame, id_col: str, auc: float, weight: str = "weight", threshold: float = 0.7) -> DataFrame:
    """Multiply training weights by 1 + p when the shift is large."""
    if auc <= threshold:
        return train
    p = scored.filter(F.col("is_test") == 0).select(id_col, F.col("p_test").alias("_p"))
    return train.join(p, id_col, "left").withColumn(weight, F.col(weight) * (1.0 + F.coalesce("_p", F.lit(0.0)))).drop("_p")


def rf_modellability(df: DataFrame, features: Sequence[str], targets: Sequence[str], group: str, n_folds: int = 5, trees: int = 120, depth: int = 14) -> DataFrame:
    """Grouped cross-validated R² of a forest per target, with a verdict."""
    out = None
    for t in targets:
        data = group_kfold(df.filter(F.col(t).isNotNull()), group, n_folds)
        make = {"rf": lambda s: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=s)}
        oof, _ = oof_predictions(cut_lineage(data), features, t, make, n_folds)
        part = oof.select(F.lit(t).alias("target"), "fold", F.col(t).alias("truth"), F.col("pred_rf").alias("pred"))
        out = part if out is None else out.unionByName(part)
    each = regression_metrics(out, by=["target", "fold"])
    mean = F.avg("r2")
    # Bounds of the verdicts.
    verdict = F.when(mean >= 0.7, "strong").when(mean >= 0.4, "moderate").when(mean >= 0.1, "weak").otherwise("none")
    return each.groupBy("target").agg(mean.alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), verdict.alias("verdict"))


def keyed_permutation(place: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where a permutation of 0 .. n-1 chosen by ``key`` sends some places.

    A Feistel network permutes the smallest square that holds n; places that land outside walk on until
    they are inside again, which keeps it a permutation of the n. Nothing is stored.
    """
    side = max(2, math.isqrt(max(n - 1, 0)) + 1)
    salts = np.random.default_rng([key, n]).integers(1, 1 << 62, (rounds, 2)).astype(np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(side), x % np.uint64(side)
        for a, b in salts:
            h = (right + b) * a
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left + (h >> np.uint64(32)) % np.uint64(side)) % np.uint64(side)
        return left * np.uint64(side) + right

    out = once(place.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _permuted(numbered_rows: DataFrame, n: int, keys: int, seed: int) -> DataFrame:
    """Every row's ``pos`` and ``x`` once per key, with the place it is sent to as ``pos``."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pos = batch["pos"].to_numpy()
            for k in range(keys):
                yield pd.DataFrame({"pos": keyed_permutation(pos, n, seed * 1_000_003 + k), "key": k, "x": batch["x"]})

    return numbered_rows.select("pos", "x").mapInPandas(send, "pos bigint, key int, x array<double>")


def permutation_importance(
    model, df: DataFrame, features: Sequence[str], label: str, id_col: str, repeats: int = 5, top: int = 15, seed: int = 42
) -> DataFrame:
    """Mean loss of R² when one feature's values are exchanged between rows.

    Rows are numbered once. Every shuffle is a computed permutation of the numbers: a row sends its values
    to its partner, and one join brings each row what it is sent for all repeats, in which every feature
    in turn takes the partner's value. The rows' order decides their numbers, so ``id_col`` must be unique.
    """
    clean = F.array(*[sanitize(F.col(f).cast("double"), fill_missing=True) for f in features])
    rows = cut_lineage(numbered(df.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("truth"), clean.alias("x")), ["_id"]))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, importance double, spread double")
    ship_code(df.sparkSession)
    sent = _permuted(rows, n, repeats, seed).withColumnRenamed("x", "_sent")
    met = rows.select("pos", "truth", "x").join(sent, "pos")
    swapped = F.transform(F.col("x"), lambda v, i: F.when(i == F.col("f"), F.get("_sent", i)).otherwise(v))
    changed = met.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))).select("f", F.col("key").alias("rep"), "truth", array_to_vector(swapped).alias(VECTOR))
    own = rows.select(F.lit(-1).alias("f"), F.lit(0).alias("rep"), "truth", array_to_vector("x").alias(VECTOR))
    scored = model.transform(changed.unionByName(own)).select("f", "rep", "truth", F.col("prediction").alias("pred"))
    each = cut_lineage(regression_metrics(scored, by=["f", "rep"]).select("f", "r2"))
    base = F.lit(each.filter("f = -1").first()["r2"])
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    out = each.filter("f >= 0").groupBy(names.alias("feature")).agg(F.avg(base - F.col("r2")).alias("importance"), F.stddev_pop(base - F.col("r2")).alias("spread"))
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def pca_projection(df: DataFrame, features: Sequence[str], id_col: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """The first components of the median-filled, centred features, and their variance shares."""
    filled = assemble(median_impute(df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features]), features), features)
    centred = StandardScaler(inputCol=VECTOR, outputCol="_c", withMean=True, withStd=False).fit(filled).transform(filled)
    fitted = PCA(k=k, inputCol="_c", outputCol="_pc").fit(centred)
    arr = vector_to_array("_pc")
    out = fitted.transform(centred).select(id_col, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])
    return out, [float(v) for v in fitted.explainedVariance.toArray()]


def fit_yeo_johnson(df: DataFrame, col: str, low: float = -2.0, high: float = 4.0, points: int = 25, rounds: int = 3) -> float:
    """The λ of largest likelihood: a grid scored in one aggregation, then finer grids around the best."""
    from terralex.functions.scalars import yeo_johnson

    y = F.col(col).cast("double")
    best = 1.0
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        slope = F.sum(F.signum(y) * F.log1p(F.abs(y)))
        row = df.filter(y.isNotNull()).agg(
            F.count(F.lit(1)).alias("n"), slope.alias("s"), *[F.var_pop(yeo_johnson(y, float(g))).alias(f"v{i}") for i, g in enumerate(grid)]
        ).first()
        if not row["n"]:
            return 1.0
        like = [-row["n"] / 2 * np.log(max(row[f"v{i}"], 1e-300)) + (g - 1) * row["s"] for i, g in enumerate(grid)]
        best = float(grid[int(np.argmax(like))])
        step = grid[1] - grid[0]
        low, high = best - step, best + step
    return best


# --- per-station regressions -----------------------------------------------------------------


def _season(day: str = "day") -> list[Column]:
    month = F.month(day) * F.lit(2 * math.pi / 12)
    return [F.sin(month), F.cos(month), year_fraction(F.col(day))]


def _linear_terms(x: str, mean: str, std: str) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), std, lambda d, s: d / F.when(s < 1e-12, 1.0).otherwise(s))


def _with_squares(z: Column, p: int, allowed: Column) -> Column:
    """1, the terms and, where allowed, their products."""
    squares = F.array(*[z[i] * z[j] for i in range(p) for j in range(i, p)])
    return F.concat(F.array(F.lit(1.0)), z, F.when(allowed, squares).otherwise(F.array().cast("array<double>")))


def _without_day(df: DataFrame, keys: Sequence[str], value: str, day: str) -> DataFrame:
    """Per key the least and largest value, their days, and the same over all other days: ranges that may leave a day out."""
    per_day = df.groupBy(*keys, day).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ends = per_day.groupBy(*keys).agg(F.min(F.struct("_lo", day)).alias("_l"), F.max(F.struct("_hi", day)).alias("_h"))
    others = per_day.join(ends, list(keys)).groupBy(*keys).agg(
        F.min(F.when(F.col(day) != F.col(f"_l.{day}"), F.col("_lo"))).alias("lo_else"), F.max(F.when(F.col(day) != F.col(f"_h.{day}"), F.col("_hi"))).alias("hi_else")
    )
    return ends.join(others, list(keys)).select(
        *keys, F.col("_l._lo").alias("lo"), F.col(f"_l.{day}").alias("lo_day"), F.col("_h._hi").alias("hi"), F.col(f"_h.{day}").alias("hi_day"), "lo_else", "hi_else"
    )


def station_ridge(samples: DataFrame, obs: DataFrame, col: str, aux: Sequence[str], min_rows: int = 5, min_share: float = 0.15) -> DataFrame:
    """Per-station regression on auxiliary values and season, fitted without the sample's own day.

    A station uses the auxiliaries known in ``min_share`` of its other days' labelled rows, ``min_rows`` of
    them at least, and the rows that have all of these; a missing value of the asked day takes their
    median. Scaling, the rule for quadratic terms, fit and range all leave the asked day out. The penalty
    is max(1, 300/n). Predictions are clipped to the range widened by 40 %.

    Moments are summed once per station and set of auxiliaries. A left-out day's rows, few each, are taken
    off them, new means and spreads turn into a linear map of the terms, and a station's days are solved
    as one array. Only moments and asked days meet in a task; days are bounded by the calendar.
    """
    p, bits = len(aux) + 3, [F.lit(1 << i).cast("long") for i in range(len(aux))]
    number = {a: F.col(a).cast("double") for a in aux}
    rows = obs.filter(F.col(col).isNotNull() & F.col("station").isNotNull()).select("station", "day", F.col(col).cast("double").alias("y"), *[v.alias(a) for a, v in number.items()])
    whole = rows.groupBy("station").agg(F.count(F.lit(1)).alias("_n"), *[F.count(a).alias(f"_c_{a}") for a in aux])
    labelled = F.col(col).isNotNull()
    own_day = obs.groupBy("station", "day").agg(
        F.count_if(labelled).alias("_own"), *[F.count_if(labelled & F.col(a).isNotNull()).alias(f"_own_{a}") for a in aux], *[F.avg(v).alias(f"_x_{a}") for a, v in number.items()]
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = F.col("_n") - zero("_own")
    enough = F.greatest(F.lit(float(min_rows)), left * min_share)
    mask = sum((F.when(F.col(f"_c_{a}") - zero(f"_own_{a}") >= enough, b).otherwise(0) for a, b in zip(aux, bits)), F.lit(0).cast("long"))
    asked = (
        samples.filter(F.col("station").isNotNull()).select("station", "day").distinct().join(own_day, ["station", "day"], "left").join(whole, "station")
        .filter(left >= min_rows).select("station", "day", mask.alias("mask"), *[f"_x_{a}" for a in aux]).filter("mask <> 0")
    )
    used = lambda i: F.col("mask").bitwiseAND(bits[i]) != 0
    # Most stations have one set of auxiliaries, some another one where a day tips the balance.
    sets = asked.select("station", "mask").distinct()
    complete = [~used(i) | F.col(a).isNotNull() for i, a in enumerate(aux)]
    terms = F.array(*[F.when(used(i), F.col(a)).otherwise(0.0) for i, a in enumerate(aux)], *_season())
    train = rows.join(sets, "station").filter(functools.reduce(lambda a, b: a & b, complete)).select("station", "mask", "day", "y", terms.alias("x"))
    key = ["station", "mask"]
    facts = train.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(p)]).alias("mean"), F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(p)]).alias("std"),
        F.array(*[F.median(F.col("x")[i]) for i in range(len(aux))]).alias("median"),
    ).filter(F.col("n") >= min_rows)
    n_aux = F.bit_count("mask")
    allowed = (F.col("n") > 3 * ((n_aux + 3) * (n_aux + 4) / 2)) & (n_aux >= 2)
    z = _linear_terms("x", "mean", "std")
    termed = train.join(facts, key).withColumn("_z", z).select(*key, "day", "y", F.concat(_with_squares(F.col("_z"), p, allowed), F.array("y")).alias("t"))
    products = F.flatten(F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.transform(F.sequence(i, F.size("t") - 1), lambda j: F.get("t", i) * F.get("t", j))))
    # One partial sum per matrix entry and station, combined map-side.
    sums = termed.select(*key, F.posexplode(products).alias("at", "v")).groupBy(*key, "at").agg(F.sum("v").alias("v"))
    gram = sums.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("gram")).toDF("of_station", "of_mask", "gram")
    ends = _without_day(termed, key, "y", "day")
    own = termed.groupBy(*key, "day").agg(F.collect_list("t").alias("own"))
    x = F.array(*[F.when(used(i), F.coalesce(f"_x_{a}", F.col("median")[i])).otherwise(0.0) for i, a in enumerate(aux)], *_season())
    jobs = asked.join(facts, key).join(ends, key).withColumn("x", x).withColumn("q", _linear_terms("x", "mean", "std")).join(own, [*key, "day"], "left").select(
        *key, "day", "q", "own",
        F.when(F.col("day") == F.col("lo_day"), F.col("lo_else")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("day") == F.col("hi_day"), F.col("hi_else")).otherwise(F.col("hi")).alias("hi"),
    )
    kinds = dict(samples.dtypes)
    ship_code(samples.sparkSession)
    solved = gram.groupBy("of_station", "of_mask").cogroup(jobs.groupBy(*key)).applyInPandas(
        _left_out_solver(p, min_rows), f"station {kinds['station']}, day {kinds['day']}, reg double, reg_conf double, reg_r2 double"
    )
    return samples.join(solved, ["station", "day"], "left")


def _rescaling(mean: np.ndarray, std: np.ndarray, squares: bool) -> np.ndarray:
    """(jobs, terms, terms) maps from 1, z and products to the same of (z - mean) / std."""
    m, p = mean.shape
    pairs = [(i, j) for i in range(p) for j in range(i, p)] if squares else []
    out = np.zeros((m, 1 + p + len(pairs), 1 + p + len(pairs)))
    out[:, 0, 0] = 1.0
    at = np.arange(1, p + 1)
    out[:, at, at] = 1.0 / std
    out[:, at, 0] = -mean / std
    for k, (i, j) in enumerate(pairs, 1 + p):
        scale = std[:, i] * std[:, j]
        out[:, k, k] = 1.0 / scale
        out[:, k, 1 + i] -= mean[:, j] / scale
        out[:, k, 1 + j] -= mean[:, i] / scale
        out[:, k, 0] = mean[:, i] * mean[:, j] / scale
    return out


def solve_without_days(gram: np.ndarray, own: list, q: np.ndarray, p: int, n_aux: int, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions at ``q`` and R² of ridge fits on some moments, each without its own rows; NaN under ``min_rows``."""
    dim = gram.shape[0]
    squares = dim > p + 2
    s = np.repeat(gram[None], len(q), 0)
    for i, rows in enumerate(own):
        if rows is not None and len(rows):
            t = np.array([np.asarray(r, float) for r in rows])
            s[i] -= t.T @ t
    n = s[:, 0, 0]
    fine = np.rint(n) >= min_rows
    n = np.where(fine, n, 1.0)
    mean = s[:, 0, 1 : p + 1] / n[:, None]
    var = s[:, range(1, p + 1), range(1, p + 1)] / n[:, None] - mean**2
    std = np.sqrt(np.maximum(var, 0.0))
    std[std < 1e-7] = 1.0
    turn = _rescaling(mean, std, squares)
    phi = np.concatenate([np.ones((len(q), 1)), q, np.stack([q[:, i] * q[:, j] for i in range(p) for j in range(i, p)], 1)] if squares else [np.ones((len(q), 1)), q], axis=1)
    phi = np.einsum("mij,mj->mi", turn, phi)[:, 1:]
    xx = turn @ s[:, :-1, :-1] @ turn.transpose(0, 2, 1)
    xy = np.einsum("mij,mj->mi", turn, s[:, :-1, -1])
    if squares:
        # Without its day a station may have too few rows for the products.
        f = n_aux + 3
        few = np.rint(n) <= 3 * (f * (f + 1) // 2)
        xx[few, p + 1 :], xx[few, :, p + 1 :], xy[few, p + 1 :] = 0.0, 0.0, 0.0
        phi[few, p:] = 0.0
    middle, y = xx[:, 0, 1:] / n[:, None], xy[:, 0] / n
    xx = xx[:, 1:, 1:] - n[:, None, None] * middle[:, :, None] * middle[:, None, :]
    xy = xy[:, 1:] - n[:, None] * middle * y[:, None]
    yy = s[:, -1, -1] - n * y**2
    alpha = np.maximum(1.0, 300.0 / n)
    coef = np.linalg.solve(xx + alpha[:, None, None] * np.eye(xx.shape[1]), xy[:, :, None])[:, :, 0]
    guess = y + ((phi - middle) * coef).sum(1)
    rest = yy - 2 * (coef * xy).sum(1) + np.einsum("mi,mij,mj->m", coef, xx, coef)
    r2 = np.where(yy > 1e-12, np.maximum(0.0, 1.0 - rest / np.where(yy > 1e-12, yy, 1.0)), 0.0)
    return np.where(fine, guess, np.nan), r2


def _left_out_solver(p: int, min_rows: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def solve(key: tuple, gram: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        names = ["station", "day", "reg", "reg_conf", "reg_r2"]
        if not len(gram) or not len(jobs):
            return pd.DataFrame(columns=names)
        upper = np.asarray(gram["gram"].iloc[0], float)
        dim = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
        full = np.zeros((dim, dim))
        full[np.triu_indices(dim)] = upper
        full = full + np.triu(full, 1).T
        n_aux = bin(int(key[1])).count("1")
        parts = []
        step = max(1, (1 << 22) // dim**2)
        for at in range(0, len(jobs), step):
            part = jobs.iloc[at : at + step]
            # Terms of auxiliaries not in use are 0 throughout, so the penalty leaves them at 0.
            guess, r2 = solve_without_days(full, list(part["own"]), np.stack(part["q"].to_numpy()), p, n_aux, min_rows)
            margin = (part["hi"] - part["lo"]).to_numpy() * 0.4
            low, high = part["lo"].to_numpy() - margin, part["hi"].to_numpy() + margin
            guess = np.minimum(np.maximum(guess, np.maximum(0.0, low)), high)
            parts.append(pd.DataFrame({"station": part["station"], "day": part["day"], "reg": guess, "reg_conf": np.minimum(r2, 0.99), "reg_r2": r2}))
        out = pd.concat(parts)
        return out[out["reg"].notna()]

    return solve


def station_boosting(
    samples: DataFrame, obs: DataFrame, col: str, aux: Sequence[str], min_rows: int = 30, trees: int = 20, seed: int = 42
) -> DataFrame:
    """One boosted model over all stations on values centred per station.

    A station's confidence is its R² on the last fifth of its rows, from a model that saw only the
    first four fifths; stations under ``min_rows`` get nothing.
    """
    rows = obs.filter(F.col(col).isNotNull())
    stats = rows.groupBy("station").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(col).alias("_my"), *[F.avg(a).alias(f"_m_{a}") for a in aux]
    ).filter(F.col("_n") >= min_rows)
    month = F.month("day") * F.lit(2 * math.pi / 12)
    feats = [f"_c_{a}" for a in aux] + ["_ms", "_mc", "_yf"]

    def terms(df: DataFrame) -> DataFrame:
        return df.join(stats, "station").withColumns(
            {**{f"_c_{a}": F.col(a) - F.col(f"_m_{a}") for a in aux}, "_ms": F.sin(month), "_mc": F.cos(month), "_yf": year_fraction(F.col("day"))}
        )

    data = assemble(terms(rows).withColumn("_y", F.col(col) - F.col("_my")), feats).withColumn("_id", F.unix_date("day").cast("bigint"))
    data = cut_lineage(temporal_holdout(data, "day", "_id", 0.8, ["station"]))
    make = lambda: GBTRegressor(featuresCol=VECTOR, labelCol="_y", maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed)
    early = make().fit(data.filter("is_train"))
    tail = early.transform(data.filter("NOT is_train")).select("station", F.col("_y").alias("truth"), F.col("prediction").alias("pred"))
    r2 = regression_metrics(tail, by=["station"]).select("station", F.greatest(F.coalesce("r2", F.lit(0.0)), F.lit(0.0)).alias("gb_r2"))
    final = make().fit(data)
    asked = samples.select("station", "day").distinct().join(obs.select("station", "day", *aux), ["station", "day"], "left")
    scored = final.transform(assemble(terms(asked), feats)).join(r2, "station", "left").select(
        "station", "day", F.greatest(F.col("prediction") + F.col("_my"), F.lit(0.0)).alias("gb"),
        F.least(F.coalesce("gb_r2", F.lit(0.0)), F.lit(0.99)).alias("gb_conf"), "gb_r2",
    )
    return samples.join(scored, ["station", "day"], "left")
