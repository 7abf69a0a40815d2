"""Small rows with the shapes on which queries failed over larger tables."""

import collections
import datetime as dt
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.operators import metrics, profiles, quality, scan, text
from terralex.session import cut_lineage, stored
from terralex.sources import observations, spread

DAY = dt.date(2024, 1, 1)


def test_correlation_of_a_constant_column(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(12)]
    rows = [("flat", d, 5.0, float(i)) for i, d in enumerate(days)] + [("few", days[0], 5.0, 1.0), ("few", days[1], 5.0, 2.0)]
    rows += [("line", d, float(i), 2.0 * i if i % 3 else None) for i, d in enumerate(days)]
    rows += [("line", d + dt.timedelta(days=20), float(i * i), -float(i)) for i, d in enumerate(days)]
    obs = spark.createDataFrame(rows, "station string, day date, a double, b double")
    got = {r["station"]: r["corr_a_b"] for r in profiles.pairwise_corr(obs, ["a", "b"], "2024-03-01").collect()}
    both = np.array([r[2:] for r in rows if r[0] == "line" and r[3] is not None])
    assert math.isnan(got["flat"]) and got["few"] == 0.0
    assert got["line"] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-12)
    scored = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "truth double, pred double")
    assert math.isnan(metrics.regression_metrics(scored).first()["pearson"])
    assert metrics.regression_metrics(scored.limit(1)).first()["pearson"] is None
    line = quality.qq_line(spark.createDataFrame([(0.0, 3.0), (1.0, 3.0)], "theoretical double, ordered double")).first()
    assert math.isnan(line["r"])


def test_pairs_are_made_without_lists_of_the_frame(spark):
    rows = [(d, p, p, (p * 7 + d) % 5) for d in (1, 2) for p in range(30)] + [(None, p, p, p) for p in range(3)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, place long, word_id long")
    pairs = text.skipgram_pairs(tokens, 3, block=4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan
    words = {(d, p): w for d, p, _, w in rows}
    got = [tuple(r) for r in pairs.select("doc_id", "place", "shift", "center", "context").collect()]
    assert len(set(got)) == len(got) and {(d, p) for d, p, *_ in got} == set(words)
    assert all(c == words[d, p] and o == words[d, p + s] and 0 < abs(s) <= 3 for d, p, s, c, o in got)
    for d, p in words:
        reach = max(abs(s) for e, q, s, *_ in got if (e, q) == (d, p))
        assert {s for e, q, s, *_ in got if (e, q) == (d, p)} == {s for s in range(-reach, reach + 1) if s and (d, p + s) in words}


def test_draws_are_looked_up_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(text, "FLUSH_EXAMPLES", 50)
    rows = [(d, p, s, (d * p) % 5, (p + s) % 5, None if d == 3 else f"t{d % 2}") for d in range(6) for p in range(5) for s in (-1, 1)]
    pairs = spark.createDataFrame(rows, "doc_id long, place long, shift long, center long, context long, turn string")
    # Slots 60 and 70 to 79 have no word, nor have those from 95 on.
    table = spark.createDataFrame([(7, 0, 60), (2, 61, 62), (4, 62, 70), (900, 80, 95)], "word_id long, slot_start long, slot_end long")
    word = {s: w for w, lo, hi in ((7, 0, 60), (2, 61, 62), (4, 62, 70), (900, 80, 95)) for s in range(lo, hi)}
    want, counted = [], collections.Counter()
    for d, p, s, c, o, turn in rows:
        counted[turn, c, o, 1] += 1
        for i in range(6):
            slot = int(int(hashlib.md5(f"42:n:{d}:{p}:{s}:{i // 4}".encode()).hexdigest()[8 * (i % 4) :][:8], 16) / 4294967296.0 * 100)
            if slot in word:
                want.append((d, p, s, c, o, turn, i + 1, slot, word[slot]))
                counted[turn, c, word[slot], 0] += 1
    key = lambda r: tuple(str(x) for x in r)
    for cells in (7, 100):
        drawn = text.negative_samples(pairs, table, 6, 100, cells=cells)
        assert drawn.columns == [*pairs.columns, "draw", "slot", "negative"]
        assert sorted(map(tuple, drawn.collect()), key=key) == sorted(want, key=key)
        met = text.sampled_examples(pairs, table, 6, 100, by=["turn"], cells=cells)
        assert sorted(map(tuple, met.collect()), key=key) == sorted(((*k, n) for k, n in counted.items()), key=key)
        for df in (drawn, met):
            assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert text.negative_samples(pairs.limit(0), table, 6, 100).count() == 0 == text.sampled_examples(pairs.limit(0), table, 6, 100).count()


def test_station_files_are_read_twice(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"S{i}").mkdir()
        (tmp_path / f"S{i}" / "data.csv").write_text(("date_time,pH\n2024-01-01,7\n", "pH,Ca,date_time\n8,1,2024-01-02\n", "no header\n")[i])
    registry = spark.createDataFrame([(f"S{i}", 1.0, 2.0) for i in range(3)], "station string, lat double, lon double")
    out = observations.load_observations(spark, str(tmp_path), registry, ["pH"])
    assert sorted((r["station"], r["day"].day, r["pH"]) for r in out.collect()) == [("S0", 1, 7.0), ("S1", 2, 8.0)]
    # The headers were read before; the plan itself reads the lines once.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1


def test_dates_are_tried_by_their_shape(spark):
    texts = [
        "2024-01-02 03:04:05", "2024-01-02 03:04", "2024-01-02", "2024/01/02 03:04:05", "2024/01/02 03:04", "2024/01/02", "01/02/2024 03:04", "01/02/2024", "2 Jan 2024",
        "12 dec 2024", " 2024-01-02", "2024-1-2", "+12024-01-02", "-2024-01-02", "2024-13-02", "2024-02-30", "32 Jan 2024", "+2 Jan 2024", "2024-01-02\n", "", "NA", "not a date", "٢٠٢٤-01-02", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in observations.DATE_FORMATS])
    rows = df.select("t", plain.cast("string").alias("plain"), observations.mixed_date(F.col("t")).cast("string").alias("mixed")).collect()
    assert all(r["plain"] == r["mixed"] for r in rows) and sum(r["mixed"] is not None for r in rows) >= 10
    # No text of one of the nine forms is tried on more forms than its own.
    shapes = [observations.form_shape(f) for f in observations.DATE_FORMATS]
    assert [[re.match(s, t) is not None for s in shapes] for t in texts[:9]] == [[i == j for i in range(9)] for j in range(9)]
    assert observations.form_shape("yyyy-MM-dd'T'HH:mm") is None and observations.form_shape("h:mm a") is None


def test_stations_are_written_by_many_tasks(spark, monkeypatch, sf_dir):
    import __spark_entry__
    from terralex.plans import q_tables

    dealt = []
    monkeypatch.setattr(q_tables, "spread", lambda df, key: dealt.append((df, key)) or spread.spread(df, key))
    __spark_entry__.queries()["load_observations"](spark, sf_dir)
    (raw, key), = dealt
    assert key == "station" and spread.spread(raw, key).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_draws_are_made_once(spark):
    pairs = spark.createDataFrame([(d, p, 1, p % 3, d % 3) for d in range(4) for p in range(5)], "doc_id long, place long, shift long, center long, context long")
    table = spark.createDataFrame([(0, 0, 30), (1, 40, 70), (2, 70, 100)], "word_id long, slot_start long, slot_end long")
    drawn = text.negative_samples(pairs, table, 6, 100).groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.sum("slot").alias("slots"))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1 and "md5" not in plan
    assert 0 < drawn.agg(F.sum("n")).first()[0] < 120


def test_corpus_is_numbered_without_keeping_its_rows(spark, monkeypatch):
    monkeypatch.setattr(text, "DOC_BLOCK", 4)
    rows = [(d, p, p % 5) for d in (7, None, 3, 12) for p in range(0, 40 if d == 3 else 9, 1 if d else 2)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, word_id long").repartition(5)
    kept = []
    # One row per document and segment is kept, no token.
    monkeypatch.setattr(scan, "cut_lineage", lambda df: kept.append(df.count()) or cut_lineage(df))
    got = text.renumber(tokens, "corpus")
    assert got.columns == ["doc_id", "pos", "word_id", "place"] and kept == [3 + 3 + 10 + 3]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == [(*r, i) for i, r in enumerate(order)]
    assert text.renumber(tokens.limit(0), "corpus").count() == 0


def test_stored_rows_are_columns(spark, sf_dir):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "n long, s string, x double")
    out = stored(df, "some")
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert all(f.endswith(".parquet") for f in out.inputFiles())


def test_tokens_are_not_shuffled_by_word(spark):
    tokens = spark.createDataFrame([(d, p, "abc"[p % 3]) for d in range(3) for p in range(6)], "doc_id long, pos int, word string")
    words = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.5)], "word string, word_id long, freq double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        got = text.encode(tokens, words)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r[:3] for r in map(tuple, got.collect())) == sorted((d, p, p % 3) for d in range(3) for p in range(6) if p % 3 < 2)
