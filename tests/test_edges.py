"""Hand-made frames and brute-force checks for nulls, ties, boundaries and hot groups."""

import datetime as dt
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralex.functions import scalars as sc
from terralex.functions.vectors import l2_normalize
from terralex.operators import calibrate, embed, impute, learn, quantiles, scan, spatial, tables, temporal, text
from terralex.sources import observations as ob
from terralex.sources import pages

DAY = dt.date(2024, 1, 1)


def history(spark, values, station="s", step=1):
    rows = [(station, DAY + dt.timedelta(days=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, day date, v double")


def column(df, name, order="day"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("segment_days", [1, 2, 100])
def test_lag_and_rolling_skip_nulls(spark, segment_days):
    obs = history(spark, [1.0, None, 3.0, None, 5.0])
    lag = temporal.lag_last_valid(obs, ["v"], segment_days)
    assert column(lag, "lag_v") == [None, 1.0, 1.0, 3.0, 3.0]
    assert column(lag, "lag_v_days") == [None, 1, 2, 1, 2]
    roll = temporal.rolling_last_n(obs, "v", [3], segment_days, block=3)
    assert column(roll, "roll3_v") == [None, None, 1.0, 1.0, 2.0]


def test_rolling_across_blocks(spark):
    rng = np.random.default_rng(0)
    values = [float(x) if x > 0.3 else None for x in rng.random(60)]
    got = column(temporal.rolling_last_n(history(spark, values), "v", [3, 5], 7, block=6), "roll5_v")
    s = pd.Series(values, dtype=float)
    want = s.dropna().rolling(5, min_periods=1).mean().shift(1).reindex(s.index).ffill()
    assert [g if g is not None else math.nan for g in got] == pytest.approx(want.tolist(), nan_ok=True)


def test_asof_is_strictly_before_and_ignores_unknown_stations(spark):
    obs = history(spark, [1.0, None, 3.0])
    asked = spark.createDataFrame([(1, "s", DAY), (2, "s", DAY + dt.timedelta(days=2)), (3, "s", DAY + dt.timedelta(days=9)), (4, None, DAY)], "id int, station string, day date")
    got = {r["id"]: (r["asof_v"], r["asof_v_days"]) for r in temporal.asof_last(asked, obs, "v").collect()}
    assert got == {1: (None, None), 2: (1.0, 2), 3: (3.0, 7), 4: (None, None)}


def test_interpolation_with_short_history_and_ties(spark):
    obs = history(spark, [2.0, 100.0, 4.0], step=2)
    asked = spark.createDataFrame([("s", DAY + dt.timedelta(days=2)), ("x", DAY)], "station string, day date")
    rows = {r["station"]: r for r in temporal.temporal_interpolation(asked, obs, "v", 7).collect()}
    assert rows["s"]["interp"] == pytest.approx(3.0) and rows["s"]["interp_conf"] == 0.95
    assert rows["x"]["interp"] is None and rows["x"]["interp_conf"] == 0.0
    near = temporal.nearest_rows(asked.filter("station = 's'").withColumn("day", F.date_add("day", 1)), obs, F.col("v"), 30)
    assert near.first()["found"] == 100.0  # a day before and a day after: the earlier one


def test_box_match_is_strict_and_takes_the_first(spark):
    registry = spark.createDataFrame([("b", 10.0, 20.0), ("a", 10.0, 20.0), ("c", 10.25, 20.0)], "station string, lat double, lon double")
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.125, 20.0), (3, 10.375, 20.0), (4, 50.0, 50.0)], "id int, lat double, lon double")
    got = {r["id"]: r["station"] for r in spatial.coord_to_station(points, registry, tol=0.125).collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("metric", [spatial.DEGREES, spatial.HAVERSINE])
def test_nearest_neighbours_equal_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    dense = rng.normal([-30, 25], 0.002, (150, 2))
    sparse = np.column_stack([rng.uniform(-85, 85, 60), rng.uniform(-180, 180, 60)])
    piles = np.repeat([[-30.0, 25.0], [10.0, 10.0]], 40, axis=0)
    refs = np.vstack([dense, sparse, piles])
    rdf = spark.createDataFrame([(i, float(a), float(b), float(i)) for i, (a, b) in enumerate(refs)], "rid long, lat double, lon double, v double")
    qs = np.vstack([dense[:20], sparse[:20] + 0.5, [[89.0, 0.0], [-30.0, 25.0], [0.0, 179.99]]])
    qdf = spark.createDataFrame([(float(a), float(b)) for a, b in qs], "lat double, lon double")
    got = {(r["lat"], r["lon"]): [(x["dist"], x["id"]) for x in r["near"]] for r in spatial.knn(qdf, rdf, "rid", 7, metric, payload=["v"]).collect()}
    for a, b in qs:
        if metric is spatial.DEGREES:
            d = np.hypot(refs[:, 0] - a, refs[:, 1] - b)
        else:
            p, q = np.radians(refs), np.radians([a, b])
            h = np.sin((p[:, 0] - q[0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(q[0]) * np.sin((p[:, 1] - q[1]) / 2) ** 2
            d = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))
        want = np.sort(d)[:7]
        found = got[(float(a), float(b))]
        assert [x[0] for x in found] == pytest.approx(want.tolist(), abs=1e-6)
        assert len({x[1] for x in found}) == 7


def test_neighbour_features_leave_the_row_itself_out(spark):
    rows = spark.createDataFrame([(i, -30.0, 25.0, float(i)) for i in range(4)], "rid long, lat double, lon double, v double")
    out = spatial.haversine_knn_features(rows, rows, "rid", ["v"], (3,), is_train=True)
    got = {r["rid"]: r["knn3_v_mean"] for r in out.collect()}
    assert got == pytest.approx({0: 2.0, 1: 5 / 3, 2: 4 / 3, 3: 1.0})


@pytest.mark.parametrize("limit", [3, 10_000])
def test_quantiles_of_large_groups_are_exact(spark, limit):
    rng = np.random.default_rng(2)
    hot = np.round(rng.normal(0, 3, 4000), 2)
    rows = [("hot", float(x)) for x in hot] + [("same", 1.5)] * 50 + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = {r["k"]: [r[n] for n in names] for r in quantiles.exact_quantiles(df, ["k"], "v", probs, names, limit).collect()}
    assert set(got) == {"hot", "same", "one"}
    assert got["hot"] == pytest.approx(np.quantile(hot, probs).tolist())
    assert got["same"] == [1.5] * 6 and got["one"] == [2.0] * 6


def test_ranks_equal_pandas(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(2, 3000), 1)
    got = {r["v"]: r["rank"] for r in quantiles.value_ranks(spark.createDataFrame([(float(a),) for a in x], "v double"), [], "v").collect()}
    want = pd.Series(x).rank()
    assert all(got[float(a)] == r for a, r in zip(x, want))


def test_slots_equal_the_sequential_fill(spark):
    for counts, slots in (([50, 20, 5, 5, 1], 40), ([9, 8, 7], 1000), ([1000, 1, 1, 1, 1, 1], 12)):
        share = np.array(counts, dtype=float) ** 0.75
        share /= share.sum()
        fill, word, total = [], 0, 0.0
        for i in range(slots):
            fill.append(word)
            if (i + 1) / slots > total + share[word]:
                total += share[word]
                word = min(word + 1, len(counts) - 1)
        vocab = spark.createDataFrame([(i, f"w{i}", c) for i, c in enumerate(counts)], "word_id long, word string, count long")
        got = {r["word_id"]: (r["slot_start"], r["slot_end"]) for r in text.negative_slots(vocab, slots).collect()}
        want = {w: (fill.index(w), slots - fill[::-1].index(w)) for w in set(fill)}
        assert got == want


def test_vocabulary_orders_equal_counts_by_first_occurrence(spark):
    docs = spark.createDataFrame([(2, "zeta beta Beta x"), (1, "zeta alpha ALPHA!")], "doc_id long, text string")
    got = [r["word"] for r in text.vocab(text.tokenize(docs, "doc_id", "text"), 10, 2).orderBy("word_id").collect()]
    assert got == ["zeta", "alpha", "beta"]


@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_pairs_lose_nothing_at_block_edges(spark, scope):
    tokens = [(d, p, (d * 7 + p) % 5, 0.1) for d in (1, 2) for p in range(0, 40, 2)]
    numbered = text.renumber(spark.createDataFrame(tokens, "doc_id long, pos int, word_id long, freq double"), scope)
    got = {(r["place"], r["shift"], r["doc_id"]) for r in text.skipgram_pairs(numbered, 3, scope=scope, block=4).collect()}
    reach = {(r["doc_id"], r["place"]): r["w"] for r in numbered.withColumn("w", F.floor(sc.hash_uniform(42, F.lit("w"), "doc_id", "pos") * 3) + 1).collect()}
    want = set()
    for (d, at), w in reach.items():
        for s in range(-w, w + 1):
            if s and any(at + s == b and (scope == "corpus" or d == e) for e, b in reach):
                want.add((at, s, d))
    assert got == want


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_top_k_by_cells(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 6))
    if kind == "clusters":
        # A third of all rows in one tight cluster, copies and zero vectors among the rest.
        m[:100] = m[0] + rng.normal(size=(100, 6)) * 0.01
        m[120:140], m[150:153] = m[120], 0.0
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")
    asks = df.select(F.col("id").alias("ask"), "vec", F.array("id", F.lit(7).cast("long")).alias("excluded"))
    one = {(r["ask"], r["rank"]): (r["id"], r["score"]) for r in embed.top_k_vectors(df, asks, 4).collect()}
    monkeypatch.setattr(embed, "ASK_ROWS", 9)
    many = {(r["ask"], r["rank"]): (r["id"], r["score"]) for r in embed.top_k_vectors(df, asks, 4, cell_rows=20).collect()}
    scores = m @ m.T
    np.fill_diagonal(scores, -np.inf)
    scores[:, 7] = -np.inf
    want = -np.sort(-scores, axis=1)[:, :4]
    for got in (one, many):
        assert len(got) == 1200
        for i in range(300):
            rows = [got[i, j + 1] for j in range(4)]
            assert np.allclose([s for _, s in rows], want[i], atol=1e-12) and len({v for v, _ in rows}) == 4
            assert np.allclose([scores[i, v] for v, _ in rows], want[i], atol=1e-12)
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(l2_normalize(F.col("v")).alias("n")).first()["n"]
    assert zero == [0.0, 0.0]
    assert embed.top_k_vectors(df.limit(0), asks, 4).count() == 0 and embed.top_k_vectors(df, asks.limit(0), 4).count() == 0


def test_training_lowers_the_loss(spark):
    docs = spark.createDataFrame([(i, "red green blue " * 30 if i % 2 else "one two three " * 30) for i in range(20)], "doc_id long, text string")
    words = text.vocab(text.tokenize(docs, "doc_id", "text"), 100, 2)
    pairs = text.skipgram_pairs(text.renumber(text.encode(text.tokenize(docs, "doc_id", "text"), words)), 2).cache()
    emb, losses = embed.train(pairs, text.negative_slots(words, 1000), words, 4, 2, epochs=3, rounds=2, lr=0.001, slots=1000)
    assert emb.count() == 6 and losses[2] < losses[1] < losses[0]


def test_chained_imputer_recovers_a_linear_column(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=300), rng.normal(size=300)
    c = 2 * a - b + 3
    rows = [(float(x), float(y), None if i % 4 == 0 else float(z)) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = impute.fit_chained_imputer(df, ["a", "b", "c"], max_rounds=3)
    out = np.array([r["c"] for r in model.transform(df).collect()])
    assert np.abs(out - c).max() < 0.05
    unseen = model.transform(df.limit(5).drop("c"))
    assert unseen.filter("c IS NULL").count() == 0


def test_calibration_edges(spark):
    stats = spark.createDataFrame([("flat", 10.0, 0.0, 10.0, 10.0)], "station string, mean double, std double, min double, max double")
    pooled = spark.createDataFrame([(10.0, 2.0)], "global_mean double, global_std double")
    pred = spark.createDataFrame([("flat", 12.0), ("other", -1.0)], "station string, pred double")
    got = {r["station"]: r["calibrated"] for r in calibrate.station_calibrate(pred, stats, pooled).collect()}
    assert got == {"flat": 12.0, "other": 0.0}
    out = {r["station"]: r["decompressed"] for r in calibrate.variance_decompress(pred, stats, pooled).collect()}
    assert out == {"flat": 10.0, "other": 0.0}


def test_station_files(spark, tmp_path):
    for station, lines in {
        "A1": ["2020-01-05,1.5,7", "not a date,2,2", "2020/02/01 10:30,#n/a,NA"],
        "B2": ["03/04/2020,,x", "2020-05-06 01:02:03,4,1e1"],
    }.items():
        os.makedirs(tmp_path / station)
        (tmp_path / station / f"{station}.csv").write_text("date_time,EC_Phys_Water,pH\n" + "\n".join(lines) + "\n")
    registry = spark.createDataFrame([("A1", -30.0, 25.0), ("B2", -31.0, 26.0)], "station string, lat double, lon double")
    rows = ob.load_observations(spark, str(tmp_path), registry, ["EC_Phys_Water", "pH", "Ca"]).orderBy("date").collect()
    assert [(r["station"], r["date"].day, r["EC_Phys_Water"], r["pH"], r["Ca"]) for r in rows] == [
        ("A1", 5, 15.0, 7.0, None), ("A1", 1, None, None, None), ("B2", 4, None, None, None), ("B2", 6, 40.0, 10.0, None),
    ]
    lines = spark.createDataFrame([("k1,1,2,3,4",), ("k2,x",)], "value string")
    assert [tuple(r) for r in ob.repair_ragged(lines, ["id", "a", "b"], ["id"]).collect()] == [("k1", 1.0, 2.0), ("k2", None, None)]


def test_coordinates_outside_the_box_are_dropped(spark):
    docs = spark.createDataFrame([(1, "Latitude -30.5 longitude  25"), (2, "latitude 30 longitude 25"), (3, "latitude longitude")], "id int, text string")
    assert [tuple(r) for r in pages.extract_coordinates(docs, "id", "text").collect()] == [(1, -30.5, 25.0)]


def test_incomplete_cache_is_computed_anew(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    compute = lambda d: d.withColumn("x", F.col("k") * 10)
    cache = spark.createDataFrame([(1, -1)], "k int, x int")
    assert sorted(map(tuple, tables.incremental_fill(keys, cache, ["k"], compute, ["x"]).collect())) == [(1, -1), (2, 20)]
    assert sorted(map(tuple, tables.incremental_fill(keys, cache.drop("x"), ["k"], compute, ["x"]).collect())) == [(1, 10), (2, 20)]


def test_yeo_johnson_round_trip(spark):
    df = spark.createDataFrame([(float(v),) for v in (-3, -0.5, 0, 1, 40)], "v double")
    for lam in (-0.7, 0.0, 1.0, 2.0, 2.6):
        out = df.select("v", sc.yeo_johnson_inverse(sc.yeo_johnson(F.col("v"), lam), lam).alias("b")).collect()
        assert all(r["b"] == pytest.approx(r["v"], abs=1e-6) for r in out)


def test_dense_position_over_segments(spark):
    df = spark.createDataFrame([("k", i) for i in range(25)], "k string, i long")
    out = scan.dense_position(df, ["k"], ["i"], scan.block_segment(F.col("i"), 4))
    assert column(out, "pos", "i") == list(range(25))


@pytest.mark.parametrize("lat,lon", [(0.0, 20.0), (70.0, -30.0), (85.0, 100.0), (-89.9, 0.0), (10.0, 180.0)])
def test_radius_pairs_equal_brute_force(spark, lat, lon):
    import math
    import random

    from terralex.operators.spatial import radius_pairs

    rng = random.Random(int(lat))

    def near(n):
        out = []
        for _ in range(n):
            b = max(-90.0, min(90.0, lat + rng.uniform(-0.3, 0.3)))
            a = lon + rng.uniform(-0.3, 0.3) / max(0.02, math.cos(math.radians(b)))
            out.append((round(b, 5), round((a + 180) % 360 - 180, 5)))
        return out

    def km(p, q):
        f1, f2, dl = math.radians(p[0]), math.radians(q[0]), math.radians(q[1] - p[1])
        h = math.sin((f2 - f1) / 2) ** 2 + math.cos(f1) * math.cos(f2) * math.sin(dl / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    locs, pois = near(40), near(200)
    pairs = radius_pairs(
        spark.createDataFrame(locs, "lat double, lon double"),
        spark.createDataFrame([(*p, "a") for p in pois], "lat double, lon double, tag string"), 10.0,
    )
    got = {(r["lat"], r["lon"]): r["n"] for r in pairs.collect()}
    want = {p: sum(km(p, q) <= 10.0 for q in pois) for p in locs}
    assert got == {p: n for p, n in want.items() if n}


def test_several_rows_on_a_day(spark):
    from terralex.operators import metrics, temporal

    rows = [("s", "2024-01-01", 1, 1.0), ("s", "2024-01-02", 1, 2.0), ("s", "2024-01-02", 2, 4.0), ("s", "2024-01-03", 1, None)]
    obs = spark.createDataFrame(rows, "station string, day string, row_id int, v double").withColumn("day", F.col("day").cast("date"))
    lags = {(str(r["day"]), r["row_id"]): r["lag_v"] for r in temporal.lag_last_valid(obs, ["v"], row_id="row_id").collect()}
    assert lags == {("2024-01-01", 1): None, ("2024-01-02", 1): 1.0, ("2024-01-02", 2): 2.0, ("2024-01-03", 1): 4.0}
    rolled = {(str(r["day"]), r["row_id"]): r["roll2_v"] for r in temporal.rolling_last_n(obs, "v", [2], row_id="row_id").collect()}
    assert rolled == {("2024-01-01", 1): None, ("2024-01-02", 1): 1.0, ("2024-01-02", 2): 1.5, ("2024-01-03", 1): 1.5}
    samples = spark.createDataFrame([("s", "2024-01-02")], "station string, day string").withColumn("day", F.col("day").cast("date"))
    assert [r["v"] for r in temporal.sameday_lookup(samples, obs, ["v"], ["row_id"]).collect()] == [2.0]
    assert [r["truth"] for r in metrics.score_match(samples, obs, "v", ["row_id"]).collect()] == [2.0]


def test_the_first_and_last_row_of_a_day(spark):
    from terralex.operators import metrics, temporal

    # In this order: 9, null, 3 on the second day, 1 and 2 on the fifth.
    rows = [("s", "2024-01-02 08:00", 9.0, 1.0), ("s", "2024-01-02 09:00", None, 2.0), ("s", "2024-01-02 10:00", 3.0, 3.0), ("s", "2024-01-05 07:00", 1.0, 4.0),
            ("s", "2024-01-05 08:00", 2.0, 5.0), ("t", "2024-01-02 08:00", None, 6.0), ("t", "2024-01-02 09:00", 7.0, 7.0)]
    obs = spark.createDataFrame(rows, "station string, date string, v double, w double").withColumn("date", F.col("date").cast("timestamp"))
    obs = obs.withColumn("day", F.col("date").cast("date")).repartition(4)
    ask = lambda *pairs: spark.createDataFrame(pairs, "station string, day string").withColumn("day", F.col("day").cast("date"))
    got = {r["station"]: r for r in metrics.score_match(ask(("s", "2024-01-02"), ("t", "2024-01-02")), obs, "v").collect()}
    assert got["s"]["truth"] == 9.0 and got["t"]["truth"] is None and not got["t"]["matched"]
    filled = {r["station"]: r["v"] for r in temporal.sameday_lookup(ask(("s", "2024-01-02"), ("t", "2024-01-02")), obs, ["v"]).collect()}
    assert filled == {"s": 9.0, "t": None}
    asked = ask(("s", "2024-01-03"), ("s", "2024-01-04"), ("s", "2024-01-05"), ("s", "2024-01-09"))
    back = {str(r["day"])[-2:]: r["asof_v"] for r in temporal.asof_last(asked, obs, "v").collect()}
    assert back == {"03": 3.0, "04": 3.0, "05": 3.0, "09": 2.0}
    # A day before: its last row. A day after: its first. The day itself: its first.
    near = {str(r["day"])[-2:]: r["found"] for r in temporal.nearest_rows(asked, obs, F.col("w"), 30).collect()}
    assert near == {"03": 3.0, "04": 4.0, "05": 4.0, "09": 5.0}
    seq = {str(r["day"])[-2:]: [x["v"] for x in r["sequence"] or []] for r in temporal.history_sequences(asked, obs, ["v"], 3).collect()}
    assert seq == {"03": [9.0, None, 3.0], "04": [9.0, None, 3.0], "05": [9.0, None, 3.0], "09": [3.0, 1.0, 2.0]}
    # The three nearest values before or after: two rows of the second day, one of the fifth.
    mixed = temporal.temporal_interpolation(ask(("s", "2024-01-03")), obs, "v", 3).first()["interp"]
    assert mixed == pytest.approx((3 / 2 + 9 / 2 + 1 / 3) / (1 / 2 + 1 / 2 + 1 / 3))
    with pytest.raises(ValueError, match="first"):
        metrics.score_match(asked, obs.drop("date"), "v")


def test_station_files_with_different_headers(spark, tmp_path):
    from terralex.sources import observations as ob

    for name, text in {
        "S1": 'date_time,pH,EC_Phys_Water\n2024-01-01,7.5,10\n2024-01-01 12:00,"7.6",11\n', "S2": "Ca,date_time\n3,2024-02-01\n",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.csv").write_text(text)
    registry = spark.createDataFrame([("S1", 1.0, 2.0), ("S2", 3.0, 4.0)], "station string, lat double, lon double")
    got = ob.load_observations(spark, str(tmp_path), registry, ["EC_Phys_Water", "pH", "Ca"]).orderBy("station", "date").collect()
    assert [(r["station"], str(r["day"]), r["EC_Phys_Water"], r["pH"], r["Ca"]) for r in got] == [
        ("S1", "2024-01-01", 100.0, 7.5, None), ("S1", "2024-01-01", 110.0, 7.6, None), ("S2", "2024-02-01", None, None, 3.0),
    ]


def test_imputer_leaves_out_a_column_without_values(spark):
    from terralex.operators import impute

    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, None, None), (3.0, 6.0, None), (4.0, 8.0, None)], "a double, b double, c double")
    model = impute.fit_chained_imputer(df, ["a", "b", "c"])
    assert model.cols == ["a", "b"] and model.converged
    assert [r["c"] for r in model.transform(df).collect()] == [None] * 4


def test_registered_imputation_never_returns_unsettled_values(spark, sf_dir, monkeypatch):
    from terralex.plans import q_adjust
    from terralex.plans.catalog import QUERIES

    fit = impute.fit_chained_imputer
    monkeypatch.setattr(q_adjust.im, "fit_chained_imputer", lambda rows, cols, **more: fit(rows.limit(200), cols, **{"max_rounds": 1} | more, tol=0.0))
    with pytest.raises(RuntimeError, match="not settled"):
        QUERIES["chained_regression_impute"](spark, sf_dir)


def test_cache_is_filled_on_disk(spark, tmp_path):
    from terralex.operators.tables import fill_cache

    path, asked = str(tmp_path / "cache"), []

    def compute(keys):
        asked.append(keys.count())
        return keys.withColumn("v", F.col("k") * 2)

    frame = lambda n: spark.range(n).withColumnRenamed("id", "k")
    assert fill_cache(frame(3), path, ["k"], compute, ["v"]).count() == 3
    assert fill_cache(frame(5), path, ["k"], compute, ["v"]).count() == 5 and asked == [3, 2]
