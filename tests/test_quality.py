"""Rank correlations and information against plain computations on small frames."""

import itertools

import numpy as np
import pytest

from terralex.operators import quality, scan, space_tree


def average_ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(1, len(v) + 1)
    for x in np.unique(v):
        out[v == x] = out[v == x].mean()
    return out


def rho_of(x, y, least):
    both = ~np.isnan(x) & ~np.isnan(y)
    if both.sum() < least:
        return 0.0, int(both.sum())
    a, b = average_ranks(x[both]), average_ranks(y[both])
    a, b = a - a.mean(), b - b.mean()
    den = np.sqrt((a @ a) * (b @ b))
    return (float(a @ b / den) if den else 0.0), int(both.sum())


def table(spark, data):
    names = list(data)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 300
    base = rng.normal(size=n)
    out = {f"x{i}": np.round(base * (i + 1) + rng.normal(size=n) * 2, 1) for i in range(6)}
    gap = rng.random(n) < 0.3
    for c in ("x2", "x3"):
        out[c][gap] = np.nan
    out["x4"][rng.random(n) < 0.5] = np.nan
    out["flat"] = np.ones(n)
    out["rare"] = np.where(np.arange(n) < 7, base, np.nan)
    return out


@pytest.mark.parametrize("narrow", [0, 10])
def test_spearman_of_all_pairs(spark, data, monkeypatch, narrow):
    monkeypatch.setattr(quality, "NARROW", narrow)
    pairs = list(itertools.combinations(data, 2)) + [("x0", "x0"), ("x5", "x1")]
    got = {(r["a"], r["b"]): (r["rho"], r["n"]) for r in quality.spearman_pairs(table(spark, data), pairs).collect()}
    assert set(got) == set(pairs)
    for a, b in pairs:
        rho, n = rho_of(data[a], data[b], 10)
        assert got[a, b] == (pytest.approx(rho, abs=1e-12), n), (a, b)


def test_columns_missing_together_are_one_class(spark, data):
    found = quality._null_classes(table(spark, data), list(data))
    assert found["x0"] == found["x1"] == found["x5"] == found["flat"] and found["x2"] == found["x3"]
    assert len(set(found.values())) == 4


def test_a_row_is_copied_once_per_column_and_class(spark, monkeypatch):
    rng = np.random.default_rng(3)
    whole = {f"c{i}": rng.normal(size=20) for i in range(12)}
    sizes = []
    tally = quality.ranked_tally
    monkeypatch.setattr(quality, "ranked_tally", lambda t, *rest: sizes.append(t.count()) or tally(t, *rest))
    quality.collinear_pairs(table(spark, whole), list(whole)).collect()
    # 20 distinct values in each of 12 columns, not in each of 66 pairs.
    assert sizes == [240]


def test_spearman_of_few_and_no_rows(spark):
    empty = table(spark, {"a": np.array([1.0]), "b": np.array([2.0])}).limit(0)
    assert [(r["rho"], r["n"]) for r in quality.spearman_pairs(empty, [("a", "b")]).collect()] == [(0.0, 0)]
    matrix = quality.spearman_matrix(empty, ["a"], ["b"]).collect()
    assert [(r["feature"], r["target"], r["rho"], r["mean_abs_rho"]) for r in matrix] == [("a", "b", 0.0, 0.0)]


# --- mutual information ----------------------------------------------------------------------


def psi(n):
    """Digamma of whole numbers by its definition: harmonic sums."""
    return -0.57721566490153286 + sum(1.0 / i for i in range(1, int(n)))


def information(x, y, k=5):
    x, y = x / (x.std() or 1.0), y / (y.std() or 1.0)
    n = len(x)
    if n <= k:
        return 0.0
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    radius = np.sort(np.maximum(dx, dy), axis=1)[:, k]
    total = 0.0
    for i in range(n):
        near = (lambda d: (d < radius[i] - 1e-9).sum()) if radius[i] > 1e-9 else (lambda d: (d < 1e-9).sum())
        total += psi(near(dx[i])) + psi(near(dy[i]))
    return max(0.0, psi(n) + psi(k) - total / n)


@pytest.mark.parametrize("few", [1 << 16, -1])
def test_information_of_neighbours(spark, monkeypatch, few):
    monkeypatch.setattr(space_tree, "FEW", few)
    monkeypatch.setattr(space_tree, "LEAF_ROWS", 32)
    rng = np.random.default_rng(4)
    n = 500
    a = rng.normal(size=n)
    data = {
        "near": a + rng.normal(size=n) * 0.3, "free": rng.normal(size=n), "steps": np.round(a * 2) / 2, "holes": np.where(rng.random(n) < 0.4, np.nan, a),
        "flat": np.ones(n), "t1": a, "t2": np.where(rng.random(n) < 0.3, np.nan, np.round(a, 1)), "t3": np.where(np.arange(n) < 4, a, np.nan),
    }
    features, targets = ["near", "free", "steps", "holes", "flat"], ["t1", "t2", "t3"]
    got = {(r["feature"], r["target"]): r["mi"] for r in quality.mutual_information(table(spark, data), features, targets).collect()}
    assert set(got) == set(itertools.product(features, targets))
    for f, t in got:
        x = np.where(np.isnan(data[f]), np.nanmedian(data[f]), data[f])
        there = ~np.isnan(data[t])
        assert got[f, t] == pytest.approx(information(x[there], data[t][there]), abs=1e-6), (f, t)
    assert got["near", "t1"] > 0.5 > 0.1 > got["free", "t1"] and got["flat", "t1"] < 1e-9


def test_information_of_no_rows(spark):
    empty = table(spark, {"a": np.array([1.0]), "b": np.array([2.0])}).limit(0)
    assert [tuple(r) for r in quality.mutual_information(empty, ["a"], ["b"]).collect()] == [("a", "b", 0.0)]


def test_running_sums_over_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v), int(c)) for g, v, c in zip(rng.choice([0, 0, 0, 1, 2], 3000), rng.permutation(3000), rng.integers(0, 9, 3000))]
    got = scan.running_sum(spark.createDataFrame(rows, "g int, v double, c long"), ["g"], ["v"], "c").collect()
    want, total = {}, {}
    for g, v, c in sorted(rows):
        total[g] = total.get(g, 0) + c
        want[g, v] = total[g]
    assert {(r["g"], r["v"]): r["running"] for r in got} == want
