"""Chained regression: the rounds on pattern moments against a loop over the rows."""

import numpy as np
import pytest

from terralex.operators import impute


def evidence_ridge(x, y, rounds=300, tol=1e-3):
    """The regression as the rows give it, centred."""
    n = len(y)
    xm, ym = x.mean(0), y.mean()
    xc, yc = x - xm, y - ym
    eig, vec = np.linalg.eigh(xc.T @ xc)
    eig, turned = np.maximum(eig, 0), vec.T @ (xc.T @ yc)
    noise, weight, old = 1 / (yc @ yc / n + np.finfo(float).eps), 1.0, None
    for _ in range(rounds):
        coef = vec @ (turned / (eig + weight / noise))
        if old is not None and np.abs(coef - old).sum() < tol:
            break
        old = coef
        rest = ((yc - xc @ coef) ** 2).sum()
        used = (noise * eig / (weight + noise * eig)).sum()
        weight, noise = (used + 2e-6) / (coef @ coef + 2e-6), (n - used + 2e-6) / (rest + 2e-6)
    coef = vec @ (turned / (eig + weight / noise))
    return coef, ym - coef @ xm


def loop(x, tol=1e-3, most=500):
    """(filled values, rounds, converged) of the plain round robin."""
    gone = np.isnan(x)
    v = np.where(gone, np.nanmean(x, axis=0), x)
    todo = sorted(np.flatnonzero(gone.any(0)), key=lambda c: (gone[:, c].sum(), c))
    for r in range(1, most + 1):
        before = v.copy()
        for c in todo:
            others = [i for i in range(x.shape[1]) if i != c]
            coef, b = evidence_ridge(v[~gone[:, c]][:, others], v[~gone[:, c], c])
            v[gone[:, c], c] = v[gone[:, c]][:, others] @ coef + b
        if np.abs(v - before).max() < tol * np.nanmax(np.abs(x)):
            return v, r, True
    return v, most, False


def frame(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), names


def holed(seed, n=400, p=5, share=0.35):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, p)) + rng.normal(scale=0.4, size=(n, p)) + rng.normal(5, 3, p)
    x[:, 1:][rng.random((n, p - 1)) < share] = np.nan
    return x


def values(model, df, names):
    return np.array([[r[n] for n in names] for r in model.transform(df).orderBy("id").collect()])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_loop(spark, seed):
    x = holed(seed)
    want, rounds, settled = loop(x, tol=1e-4)
    df, names = frame(spark, x)
    model = impute.fit_chained_imputer(df, names, tol=1e-4)
    assert (model.rounds, model.converged) == (rounds, settled) and rounds > 3
    assert np.abs(values(model, df, names) - want).max() < 1e-9


def test_unsettled_runs_say_so(spark):
    x = holed(4)
    df, names = frame(spark, x)
    model = impute.fit_chained_imputer(df, names, max_rounds=3, tol=1e-9)
    want, rounds, settled = loop(x, tol=1e-9, most=3)
    assert (model.rounds, model.converged) == (3, False) == (rounds, settled)
    assert np.abs(values(model, df, names) - want).max() < 1e-9


def test_large_pattern_tables_stay_in_spark(spark, monkeypatch):
    x = holed(5, n=80, p=3)
    df, names = frame(spark, x)
    few = impute.fit_chained_imputer(df, names)
    monkeypatch.setattr(impute, "PATTERN_NUMBERS", 10)
    rows = impute.fit_chained_imputer(df, names)
    assert few.rounds == rows.rounds and np.allclose(values(few, df, names), values(rows, df, names), atol=1e-9)


def test_doubt_is_decided_in_several_passes(spark, monkeypatch):
    x = holed(6)
    want, rounds, _ = loop(x, tol=1e-4)
    df, names = frame(spark, x)
    # Room for the table, but for the maps of one round a pass.
    monkeypatch.setattr(impute, "PATTERN_NUMBERS", 16 * (21 + 30 + 10))
    model = impute.fit_chained_imputer(df, names, tol=1e-4)
    assert model.rounds == rounds and np.abs(values(model, df, names) - want).max() < 1e-9


def test_new_patterns_and_columns(spark):
    x = holed(7)
    x[:, 4] = np.nan_to_num(x[:, 4], nan=1.0)
    df, names = frame(spark, x)
    model = impute.fit_chained_imputer(df, names)
    # A pattern the fit never saw: the first and last columns missing, and a column the frame lacks.
    new = df.limit(20).drop("c4").selectExpr("id", "CAST(NULL AS DOUBLE) AS c0", "c1", "c2", "c3")
    got = model.transform(new).orderBy("id").collect()
    assert all(r[c] is not None for r in got for c in names)
    start = np.array([[model.means[c] if r[c] is None else r[c] for c in names[:4]] + [model.means["c4"]] for r in new.orderBy("id").collect()])
    gone = np.array([[r[c] is None for c in names[:4]] + [True] for r in new.orderBy("id").collect()])
    for target, others, coef, b in model.steps:
        t = names.index(target)
        start[gone[:, t], t] = start[gone[:, t]][:, [names.index(o) for o in others]] @ np.array(coef) + b
    assert np.allclose(np.array([[r[c] for c in names] for r in got]), start, atol=1e-9)


def test_many_columns_and_empty(spark):
    x = np.random.default_rng(8).normal(size=(30, 70))
    x[::3, 65] = np.nan
    df, names = frame(spark, x)
    model = impute.fit_chained_imputer(df, names)
    want, rounds, _ = loop(x)
    assert model.rounds == rounds and np.allclose(values(model, df, names), want, atol=1e-8)
    none = impute.fit_chained_imputer(df.limit(0), names)
    assert none.cols == [] and none.converged and none.transform(df).count() == 30
