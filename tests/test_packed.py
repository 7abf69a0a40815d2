"""Digests of many messages, packed examples and blocks that add them up, against plain counts and rows."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralex.functions.md5 import md5_words
from terralex.operators import embed, text


def test_digests_of_many_messages(monkeypatch):
    monkeypatch.setattr("terralex.functions.md5.CHUNK", 7)
    heads = [bytes(97 + (i * j) % 26 for j in range(i % 71)) for i in range(150)]
    tails = [b"", b"0", b"12"]
    for kind in (pa.binary(), pa.large_binary()):
        got = md5_words(pa.array(heads, kind).slice(3), tails)
        assert [r.astype(">u4").tobytes() for r in got] == [b"".join(hashlib.md5(h + t).digest() for t in tails) for h in heads[3:]]
        assert md5_words(pa.array([], kind), tails).shape == (0, 12)


def test_words_of_slots_by_either_way(spark, monkeypatch):
    # Slots 60 and 70 to 79 have no word, nor have those from 95 on.
    table = spark.createDataFrame([(7, 0, 60), (2, 61, 62), (4, 62, 70), (900, 80, 95)], "word_id long, slot_start long, slot_end long")
    direct = text._SlotWords(table, 100, 7).find(np.arange(100))
    monkeypatch.setattr(text, "DIRECT_SLOTS", 0)
    assert (text._SlotWords(table, 100, 7).find(np.arange(100)) == direct).all()
    assert collections.Counter(direct.tolist()) == {0: 60, 1: 1, 2: 8, 3: 15, -1: 16}


def drawn(spark, words=40):
    """Pairs in two turns, and the examples that they and their draws are."""
    rows = [(d, p, s, d * p % words, (p * p + s) % words, d % 2) for d in range(9) for p in range(30) for s in (-2, -1, 1)]
    pairs = spark.createDataFrame(rows, "doc_id long, place long, shift long, center long, context long, turn int").repartition(3)
    table = spark.createDataFrame([(i, 5 * i, 5 * i + 5) for i in range(words - 3)], "word_id long, slot_start long, slot_end long")
    return pairs, table, text.training_examples(pairs, text.negative_samples(pairs, table, 6, 200), ["turn"])


@pytest.mark.parametrize("most", [100, 1 << 23])
def test_packed_examples_hold_all_rows(spark, monkeypatch, most):
    monkeypatch.setattr(text, "PACK_EXAMPLES", most)
    pairs, table, rows = drawn(spark)
    parts, got = 3, collections.Counter()
    packed = text.sampled_examples(pairs, table, 6, 200, by=["turn"], parts=parts)
    for r in packed.collect():
        c, away = divmod(r["block"], parts)
        for center, other, label, times in zip(*text.piece_examples(r["width"], r["steps"], r["leaps"])):
            got[r["turn"], center * parts + c, other * parts + (c + away) % parts, label] += times
    assert got == {tuple(r)[:4]: r["times"] for r in rows.collect()}
    # Far words: steps of more than 32 bits.
    far = pairs.withColumn("center", F.col("center") * 50_000_000)
    wide = text.sampled_examples(far, table, 6, 200, parts=1).collect()
    found = {(c, o, l) for r in wide for c, o, l, _ in zip(*text.piece_examples(r["width"], r["steps"], r["leaps"]))}
    assert found == {(r["center"] * 50_000_000, r["other"], r["label"]) for r in rows.collect()}


def embedded(spark, words=40, dim=4):
    rng = np.random.default_rng(5)
    v, u = rng.normal(size=(words, dim)), rng.normal(size=(words, dim))
    return spark.createDataFrame([(i, v[i].tolist(), u[i].tolist()) for i in range(words)], "word_id long, center_vec array<double>, context_vec array<double>")


def moved(df):
    rows = sorted(map(tuple, df.collect()))
    return [r[0] for r in rows], np.array([r[1] + r[2] for r in rows])


@pytest.mark.parametrize("cells", [0, 1 << 23])
def test_loss_of_packed_examples(spark, monkeypatch, cells):
    monkeypatch.setattr(embed, "MATRIX_CELLS", cells)
    monkeypatch.setattr(embed, "STRIP_CELLS", 20)
    pairs, table, rows = drawn(spark)
    # The last words have no vectors.
    emb = embedded(spark).filter("word_id < 35")
    for parts in (1, 4):
        packed = text.sampled_examples(pairs, table, 6, 200, parts=parts)
        want, got = embed.forward_loss(rows, emb, parts).first(), embed.forward_loss(packed, emb, parts).first()
        assert got["n_pairs"] == want["n_pairs"] and abs(got["loss"] - want["loss"]) < 1e-12
        # Neither the examples nor their counts are shuffled as rows.
        plan = embed.forward_loss(packed, emb, parts)._jdf.queryExecution().executedPlan().toString()
        assert "label" not in plan and "steps" in plan


@pytest.mark.parametrize("cells", [0, 1 << 23])
def test_gradients_of_packed_examples(spark, monkeypatch, cells):
    monkeypatch.setattr(embed, "MATRIX_CELLS", cells)
    monkeypatch.setattr(embed, "STRIP_CELLS", 20)
    pairs, table, rows = drawn(spark)
    emb = embedded(spark).filter("word_id < 35")
    for parts, cap in ((1, None), (4, 3)):
        packed = text.sampled_examples(pairs, table, 6, 200, parts=parts)
        (ids, want), (same, got) = (moved(embed.gradient_step(x, emb, 0.1, 4, cap, parts)) for x in (rows, packed))
        assert ids == same and np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("cells", [0, 1 << 23])
def test_packed_examples_move_vectors_in_the_same_order(spark, monkeypatch, cells):
    """A turn's examples in order of their hash, in the same batches as rows, also where a batch goes on in the next turn."""
    monkeypatch.setattr(embed, "MATRIX_CELLS", cells)
    pairs, table, rows = drawn(spark)
    sides, parts = embed._sides(embedded(spark)), 2
    packed = text.sampled_examples(pairs, table, 6, 200, by=["turn"], parts=parts)
    for shift in range(parts):
        mine = rows.filter(F.pmod(F.col("other") % parts - F.col("center") % parts, F.lit(parts)) == shift)
        pieces = packed.filter(F.col("block") % parts == shift)
        done = lambda x: {tuple(r)[:2]: r["vec"] for r in embed._run_blocks(sides, x, parts, shift, 0.1, 50, 2).filter(F.col("kind") != embed.EXAMPLE).collect()}
        want, got = done(mine), done(pieces)
        assert want.keys() == got.keys() and len(want) == 80 and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_order_of_hashes(spark):
    rows = [(a * 10**k, b, label) for a in range(5) for k in range(9) for b in (0, 1, 77, 2**40) for label in (0, 1)]
    df = spark.createDataFrame(rows, "a long, b long, label int")
    want = [tuple(r) for r in df.orderBy(F.xxhash64("a", "b", "label"), "a", "b", "label").collect()]
    assert [rows[i] for i in embed._hash_order(*map(np.array, zip(*rows)))] == want
