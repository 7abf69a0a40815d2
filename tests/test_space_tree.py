"""The adaptive space tree against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.operators import space_tree, spatial


def km(a, b):
    la, lo = np.radians(a[:, None, 0]), np.radians(a[:, None, 1])
    lb, lp = np.radians(b[None, :, 0]), np.radians(b[None, :, 1])
    h = np.sin((la - lb) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lo - lp) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def degrees(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))


def crowded(rng, n):
    """Most places in one dense spot, some spread over the globe, poles and date line among them, and copies."""
    dense = rng.normal([10, 20], 0.001, (n // 2, 2))
    wide = np.column_stack([rng.uniform(-90, 90, n // 2), rng.uniform(-180, 180, n // 2)])
    out = np.concatenate([dense, wide])
    out[:5] = [[90, 0], [-90, 50], [0, 180], [0, -180], [0, 179.9]]
    out[5:30] = out[30:55]
    out[60:80] = out[60]
    return out


@pytest.fixture(params=["few", "many"], autouse=True)
def size(request, monkeypatch):
    """Both ways: references sent to all tasks, and leaves met by a shuffle."""
    if request.param == "many":
        monkeypatch.setattr(space_tree, "FEW", -1)


@pytest.mark.parametrize("metric, far", [(spatial.HAVERSINE, km), (spatial.DEGREES, degrees)])
def test_knn_against_all_pairs(spark, monkeypatch, metric, far):
    monkeypatch.setattr(space_tree, "LEAF_ROWS", 16)
    monkeypatch.setattr(space_tree, "ASK_ROWS", 50)
    rng = np.random.default_rng(1)
    refs, asks = crowded(rng, 1200), crowded(rng, 300)
    rdf = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(refs)], "rid long, lat double, lon double")
    qdf = spark.createDataFrame([(float(a), float(b)) for a, b in asks] + [(None, 1.0)], "lat double, lon double")
    got = {(r["lat"], r["lon"]): [(x["dist"], x["id"]) for x in r["near"]] for r in spatial.knn(qdf, rdf, "rid", 7, metric).collect()}
    dist = far(asks, refs)
    assert set(got) == {tuple(a) for a in asks}
    for a, d in zip(asks, dist):
        want = np.sort(d)[:7]
        near = got[tuple(a)]
        assert np.allclose([x for x, _ in near], want, atol=1e-6) and near == sorted(near)
        sure = np.flatnonzero(d < want[-1] - 1e-6)
        assert set(sure) <= {i for _, i in near}


def test_knn_by_group(spark, monkeypatch):
    monkeypatch.setattr(space_tree, "LEAF_ROWS", 8)
    rng = np.random.default_rng(2)
    refs = [(i, int(g), float(a), float(b)) for i, (g, a, b) in enumerate(zip(rng.choice([0, 0, 0, 0, 1, 2], 500), *rng.uniform(0, 5, (2, 500))))] + [(900, 7, 1.0, 1.0)]
    df = spark.createDataFrame(refs, "rid long, region long, lat double, lon double")
    asks = df.select("region", "lat", "lon").unionByName(spark.createDataFrame([(8, 1.0, 1.0)], "region long, lat double, lon double"))
    got = {(r["region"], r["lat"], r["lon"]): [x["id"] for x in r["near"]] for r in spatial.knn(asks, df, "rid", 4, by=["region"]).collect()}
    for _, g, a, b in refs:
        mine = sorted((np.hypot(a - x, b - y), i) for i, h, x, y in refs if h == g)[:4]
        assert got[g, a, b] == [i for _, i in mine]
    assert (8, 1.0, 1.0) not in got


def test_knn_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "rid long, lat double, lon double")
    assert spatial.knn(df.limit(0), df, "rid", 2).count() == 0
    assert spatial.knn(df, df.limit(0), "rid", 2).count() == 0


def test_one_reference_place_for_all(spark, monkeypatch):
    monkeypatch.setattr(space_tree, "LEAF_ROWS", 4)
    same = spark.range(200).select(F.col("id").alias("rid"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    ((near,),) = spatial.knn(same, same, "rid", 5).select("near").collect()
    assert [x["id"] for x in near] == [0, 1, 2, 3, 4]


def test_tree_touches_every_leaf_in_reach():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(400, 2)), np.zeros(400)])
    tree = space_tree.SpaceTree.over(x, 5)
    leaf = tree.leaf(x)
    assert np.bincount(leaf, minlength=32).max() <= 20
    who, leaves = tree.touched(x[:50], np.full(50, 0.3))
    hit = set(zip(who.tolist(), leaves.tolist()))
    for i in range(50):
        inside = np.abs(x[:, :2] - x[i, :2]).max(1) <= 0.3
        assert {(i, v) for v in leaf[inside].tolist()} <= hit


def test_tree_parts_a_line_that_holds_most_places():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.exponential(size=4096) * 50, rng.normal(size=4096), np.zeros(4096)])
    x[rng.random(4096) < 0.6, 0] = 20.0
    tree = space_tree.SpaceTree.over(x, 6)
    assert np.bincount(tree.leaf(x), minlength=64).max() <= 4 * 4096 / 64
    steps = np.column_stack([np.arange(4096) % 2, np.zeros(4096)]).astype(float)
    assert set(np.bincount(space_tree.SpaceTree.over(steps, 3).leaf(steps))) == {0, 2048}
