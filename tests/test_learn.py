"""Per-station regressions, importances and splits against plain computations on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from terralex.operators import learn, scan, spatial

DAY = dt.date(2020, 1, 3)


# --- station_ridge: one fit per day, as the rows give it --------------------------------------


def season(d):
    return [np.sin(2 * np.pi * d.month / 12), np.cos(2 * np.pi * d.month / 12), d.year + d.timetuple().tm_yday / 365.25]


def fit_without(rows, day):
    """rows: (day, y, aux values, NaN where missing). Prediction and R² for a day, from all other days."""
    train = [(d, y, a) for d, y, a in rows if d != day and not np.isnan(y)]
    if len(train) < 5:
        return None
    values = np.array([a for _, _, a in train])
    good = [i for i in range(values.shape[1]) if (~np.isnan(values[:, i])).sum() >= max(5, 0.15 * len(train))]
    train = [r for r in train if not np.isnan(r[2][good]).any()]
    if not good or len(train) < 5:
        return None
    x = np.array([[*a[good], *season(d)] for d, _, a in train])
    y = np.array([v for _, v, _ in train])
    own = [a for d, _, a in rows if d == day]
    mine = np.nanmean(own, axis=0) if own else np.full(values.shape[1], np.nan)
    q = np.array([*[np.median(x[:, k]) if np.isnan(mine[i]) else mine[i] for k, i in enumerate(good)], *season(day)])
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-10, 1.0, std)
    x, q = (x - mean) / std, (q - mean) / std
    p = x.shape[1]
    if len(y) > 3 * (p * (p + 1) // 2) and len(good) >= 2:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        x, q = np.column_stack([x, *[x[:, i] * x[:, j] for i, j in pairs]]), np.concatenate([q, [q[i] * q[j] for i, j in pairs]])
    xm, ym = x.mean(0), y.mean()
    coef = np.linalg.solve((x - xm).T @ (x - xm) + max(1.0, 300 / len(y)) * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    rest = ((y - ym - (x - xm) @ coef) ** 2).sum()
    margin = (y.max() - y.min()) * 0.4
    guess = min(max(ym + coef @ (q - xm), max(0.0, y.min() - margin)), y.max() + margin)
    return guess, max(0.0, 1 - rest / ((y - ym) ** 2).sum())


def histories():
    rng = np.random.default_rng(6)
    out = {}
    for station, n, holes in ((1, 24, 0.0), (2, 80, 0.1), (3, 60, 0.0), (4, 6, 0.0), (5, 3, 0.0), (6, 41, 0.3), (7, 64, 0.0)):
        rows = []
        for i in range(n):
            a = rng.normal(size=3)
            y = 20 + 3 * a[0] - 2 * a[1] + a[0] * a[1] + rng.normal(0, 0.3)
            a[rng.random(3) < holes] = np.nan
            rows.append((DAY + dt.timedelta(days=11 * i), y if rng.random() > holes / 2 else np.nan, a))
        out[station] = rows
    # The third auxiliary of station 3 is known in 9 of 60 rows: enough, or not, as the day goes.
    for i, r in enumerate(out[3]):
        r[2][2] = np.nan if i >= 9 else r[2][2]
    # One day holds both ends of the range.
    out[4][2] = (out[4][2][0], 90.0, out[4][2][2])
    # Station 7 has two rows on some days, 64 rows in all: quadratic terms need more than 63.
    out[7] = [(DAY + dt.timedelta(days=17 * (i // 2 if i < 20 else i)), y, a) for i, (_, y, a) in enumerate(out[7])]
    return out


def test_station_ridge_equals_a_fit_per_day(spark):
    held = histories()
    value = lambda v: None if np.isnan(v) else float(v)
    rows = [(s, d, value(y), *map(value, a)) for s, listed in held.items() for d, y, a in listed]
    obs = spark.createDataFrame(rows, "station long, day date, y double, p double, q double, r double")
    extra = [(s, DAY + dt.timedelta(days=5)) for s in held] + [(None, DAY), (99, DAY)]
    asked = obs.select("station", "day").union(spark.createDataFrame(extra, "station long, day date"))
    got = {(r["station"], r["day"]): r for r in learn.station_ridge(asked, obs, "y", ["p", "q", "r"]).collect()}
    quadratic = 0
    for (station, day), r in got.items():
        want = fit_without(held[station], day) if station in held else None
        if want is None:
            assert r["reg"] is None, (station, day)
            continue
        quadratic += sum(not np.isnan(y) for _, y, _ in held[station]) > 63
        assert (r["reg"], r["reg_r2"], r["reg_conf"]) == (pytest.approx(want[0], abs=1e-7), pytest.approx(want[1], abs=1e-7), pytest.approx(min(want[1], 0.99), abs=1e-7)), (station, day)
    assert quadratic > 50 and got[(5, DAY)]["reg"] is None


# --- permutations ----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_keyed_permutation(n):
    seen = {tuple(learn.keyed_permutation(np.arange(n), n, key)) for key in range(8)}
    assert all(sorted(p) == list(range(n)) for p in seen)
    assert len(seen) > 1 or n < 4
    # A part of the places goes where the whole sends it.
    whole = learn.keyed_permutation(np.arange(n), n, 3)
    assert (learn.keyed_permutation(np.arange(n)[::2], n, 3) == whole[::2]).all()


def test_numbered_follows_the_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("pos_of"))
    got = scan.numbered(df, ["k"]).collect()
    assert all(r["k"] == r["pos"] for r in got) and len(got) == 5000
    assert sorted(r["pos"] for r in scan.numbered(df).collect()) == list(range(5000))
    assert scan.numbered(df.limit(0), ["k"]).count() == 0


def test_permutation_importance_by_hand(spark):
    rng = np.random.default_rng(4)
    n, names = 400, ["a", "b", "c"]
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] + x[:, 1] + rng.normal(0, 0.1, n)
    x[5, 1] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    fitted = LinearRegression(featuresCol=learn.VECTOR, labelCol="y").fit(learn.assemble(df, names))
    got = {r["feature"]: (r["importance"], r["spread"]) for r in learn.permutation_importance(fitted, df, names, "y", "id").collect()}
    clean = np.nan_to_num(x)
    score = lambda v: 1 - ((y - v @ fitted.coefficients.toArray() - fitted.intercept) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for f, name in enumerate(names):
        drops = []
        for key in range(5):
            v = clean.copy()
            v[learn.keyed_permutation(np.arange(n), n, 42 * 1_000_003 + key), f] = clean[:, f]
            drops.append(score(clean) - score(v))
        assert got[name] == (pytest.approx(np.mean(drops), abs=1e-9), pytest.approx(np.std(drops), abs=1e-9))
    assert got["a"][0] > got["b"][0] > 0.05 > got["c"][0]
    assert learn.permutation_importance(fitted, df.limit(0), names, "y", "id").count() == 0


# --- splits ----------------------------------------------------------------------------------


def greedy(sizes, n):
    loads, out = [0] * n, []
    for s in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        out.append(f)
    return loads, out


def test_groups_of_one_size_are_dealt_as_one_by_one():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n = int(draw.integers(1, 7))
        loads = [int(v) for v in draw.integers(0, 50, n)]
        size, groups = int(draw.integers(1, 12)), int(draw.integers(0, 40))
        want, counts = list(loads), [0] * n
        for _ in range(groups):
            f = want.index(min(want))
            want[f] += size
            counts[f] += 1
        assert learn.deal(loads, size, groups) == counts and loads == want


def test_group_kfold_balances_as_the_greedy_rule(spark):
    draw = np.random.default_rng(2)
    sizes = [400, 90, 90, 60, 33, 33, 33, 7, 7, 7, 7, *[int(v) for v in draw.integers(1, 5, 60)]]
    df = spark.createDataFrame([(i, k) for i, s in enumerate(sizes) for k in range(s)], "g int, k int")
    got = learn.group_kfold(df, "g", 5).collect()
    fold = {}
    for r in got:
        fold.setdefault(r["g"], set()).add(r["fold"])
    assert len(got) == sum(sizes) and all(len(v) == 1 for v in fold.values())
    loads = [sum(r["fold"] == f for r in got) for f in range(5)]
    assert loads == greedy(sorted(sizes, reverse=True), 5)[0]
    few = learn.group_kfold(df.filter("g < 3"), "g", 5).select("g", "fold").distinct().collect()
    assert sorted(tuple(r) for r in few) == [(0, 0), *sorted((r["g"], r["fold"]) for r in few if r["g"])] and {r["fold"] for r in few} == {0, 1, 2}
    assert learn.group_kfold(df.limit(0), "g", 5).count() == 0


def test_holdout_over_everything(spark):
    df = spark.range(1000).select("id", F.date_add(F.lit(DAY), ((F.col("id") * 37) % 11).cast("int")).alias("day"))
    got = learn.temporal_holdout(df, "day", "id", 0.8).collect()
    order = sorted((r["day"], r["id"]) for r in got)
    assert {(r["day"], r["id"]) for r in got if r["is_train"]} == set(order[:800])


# --- evaluation by left-out groups, chains ----------------------------------------------------


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(3)
    spots = np.column_stack([rng.uniform(-34, -30, 24), rng.uniform(17, 21, 24)])
    rows = []
    for i in range(240):
        g = i % 24
        v = float(rng.normal() + g / 4)
        rows.append((i, g, g % 4, float(spots[g, 0]), float(spots[g, 1]), v, None if i % 7 == 0 else v * 2, abs(3 * v + float(rng.normal()))))
    return spark.createDataFrame(rows, "id long, g int, fold int, lat double, lon double, x double, aux double, y double").cache()


@pytest.mark.parametrize("kind", ["int", "long"])
def test_one_search_serves_all_folds(spark, places, kind):
    places = places.withColumn("fold", F.col("fold").cast(kind))
    held = spatial.fold_neighbours(places, "id", ["aux"], 10, 4)
    for f in range(4):
        got = held.select("id", "fold", spatial.seen_neighbours("by_fold", f, "id").alias("_nb"))
        got = {r["id"]: r for r in got.select("id", *[v.alias(n) for n, v in spatial.neighbour_means(F.col("_nb"), ["aux"], (5, 10)).items()]).collect()}
        train, left = places.filter(F.col("fold") != f), places.filter(F.col("fold") == f)
        want = spatial.haversine_knn_features(train, train, "id", ["aux"], (5, 10), is_train=True).collect()
        want += spatial.haversine_knn_features(left, train, "id", ["aux"], (5, 10)).collect()
        for r in want:
            for c in ("knn5_aux_mean", "knn10_aux_mean", "knn5_aux_wmean", "knn10_aux_wmean", "nn_dist_km"):
                assert got[r["id"]][c] == pytest.approx(r[c], abs=1e-9), (f, r["id"], c)


def test_leave_group_out_scores_are_those_of_the_fold(spark, places):
    tree = {"tree": lambda s: DecisionTreeRegressor(maxDepth=3, seed=s), "line": lambda s: LinearRegression(regParam=0.1)}
    got = {(r["fold"], r["part"]): r for r in learn.leave_group_out_eval(places, ["x"], ["aux"], "y", "id", "g", 4, tree).collect()}
    assert set(got) == {(f, p) for f in range(4) for p in ("train", "held_out")}
    assert all(got[f, "held_out"]["n_matched"] == 60 and got[f, "train"]["n_matched"] == 180 for f in range(4))
    # Fold 2 by hand.
    train, left = places.filter("fold <> 2"), places.filter("fold = 2")
    tr = learn.group_kfold(spatial.haversine_knn_features(train, train, "id", ["aux"], (5, 10), is_train=True).drop("fold"), "g", 3)
    te = spatial.haversine_knn_features(left, train, "id", ["aux"], (5, 10))
    names = ["x", *[f"knn{k}_aux_{m}" for k in (5, 10) for m in ("mean", "wmean")], "nn_dist_km"]
    model, _ = learn.fit_stacked(tr, names, "y", tree, 3)
    top = 2 * train.agg(F.max("y")).first()[0]
    rows = model.predict(te, "p").select("y", "p").collect()
    y, p = np.array([r["y"] for r in rows]), np.clip([r["p"] for r in rows], 0, top)
    assert got[2, "held_out"]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)


def test_chained_models_predict_new_rows(spark, places):
    make = lambda s: DecisionTreeRegressor(maxDepth=3, seed=s)
    out, chain = learn.target_chaining(places, ["x"], ["aux", "y"], "id", 4, make)
    new = places.select("id", (F.col("x") + 0.1).alias("x"))
    got = {r["id"]: r for r in chain.predict(new).collect()}
    first = {r["id"]: r["pred_chain"] for r in chain.models["aux"].predict(new).collect()}
    assert all(got[i]["chain_aux"] == first[i] for i in got)
    again = chain.models["y"].predict(new.join(spark.createDataFrame(list(first.items()), "id long, chain_aux double"), "id"))
    assert {r["id"]: r["pred_chain"] for r in again.collect()} == {i: got[i]["chain_y"] for i in got}
    assert out.count() == 240 and {"chain_aux", "chain_y"} <= set(out.columns) and set(new.columns) | {"chain_aux", "chain_y"} == set(chain.predict(new).columns)


def test_out_of_fold_rows_are_predicted_by_the_other_folds(spark, places):
    oof, models = learn.oof_predictions(places, ["x"], "y", {"line": lambda s: LinearRegression()}, 4)
    rows = oof.select("id", "fold", "x", "y", "pred_line").collect()
    for f in range(4):
        seen = [r for r in rows if r["fold"] != f]
        slope, at = np.polyfit([r["x"] for r in seen], [r["y"] for r in seen], 1)
        for r in rows:
            if r["fold"] == f:
                assert r["pred_line"] == pytest.approx(slope * r["x"] + at, abs=1e-6)
    assert len(models.models["line"]) == 4
