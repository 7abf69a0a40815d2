"""Hard negatives, nearest neighbours and conversation repair against brute force, and their edge cases."""

import hashlib
import math
import random
from itertools import product

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from terralex.llm import conversation_repair, hard_negatives, multiprobe, vector_blocks
from terralex.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


# --- hard negatives --------------------------------------------------------------------------


def mined_by_hand(rows):
    """rows: (id, vector, label) that take part, labels as they count; every copy is a row of its own."""
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows]
    out = []
    for n, (a, va, la) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l) for m, (i, v, l) in enumerate(rows) if m != n and len(v) == len(va))
        for s, p, _ in [r for r in scored if r[2] == la][:5]:
            window = [r for r in scored if r[2] != la and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(window)]
    return sorted(out)


def moved(rows):
    return [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]


def mine(spark, rows, schema=VECTORS):
    got = hard_negatives.mine(hard_negatives.mining_rows(spark.createDataFrame(rows, schema))).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_conversations"])
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df, connect(sf_dir), ORACLES[name]) is None


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + rng.standard_normal(8) * 0.6).tolist(), int(i % 6 // 2)) for i in range(600)]
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    want = mined_by_hand(moved(rows))
    assert want and mine(spark, rows) == want


def test_hard_negatives_ties_and_repeats(spark):
    same = [(i, [1.0, 0.5], i % 2) for i in range(1, 40)] + [(100, [1.0, 0.5], 0), (100, [1.0, 0.5], 0), (200, [-1.0, 0.0], 1)]
    want = mined_by_hand(moved(same))
    assert mine(spark, same) == want
    # Both copies of the anchor mine for themselves.
    assert sum(r[0] == 100 for r in want) == 50


def test_hard_negatives_leave_out_bad_rows(spark):
    good = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0, 1.0], 2)]
    bad = [(4, None, 2), (5, [1.0, None], 2), (6, [1.0, float("nan")], 2), (8, [float("inf"), 0.0], 2), (9, [0.95, 0.0], None), (None, [0.95, 0.0], 2)]
    frame = spark.createDataFrame(good + bad, VECTORS).withColumns({"row": F.lit("x"), "is_anchor": F.lit(1), "slot": F.lit(2)})
    got = hard_negatives.mine(hard_negatives.mining_rows(frame)).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 65536, 230 * 256)]
    assert mine(spark, []) == []
    assert mine(spark, [(100, [1.0], 1)]) == []


def test_products_stay_exact_beyond_doubles():
    big = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    want = [[2**80, 2**80], [2**80, 2**80]]
    assert (hard_negatives.products(big, big) == np.minimum(np.array(want, object), 2**63 - 1)).all()
    wide = np.array([[2.0**30, 3.0]])
    assert hard_negatives.products(wide, wide)[0, 0] == 2**60 + 9


def test_best_keeps_the_least_ids_of_ties():
    rng = np.random.default_rng(5)
    for dtype in (np.float64, np.int64):
        best = vector_blocks.Best(7, 3, dtype)
        rows = []
        for _ in range(40):
            g, s, i = rng.integers(0, 7, 50), rng.integers(0, 6, 50).astype(dtype), rng.integers(0, 1000, 50)
            best.offer(g, s, i, i)
            rows += list(zip(g, s, i))
        got = sorted(zip(*(c.tolist() for c in best.entries()[:3])))
        want = []
        for g in range(7):
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:3]
        assert got == sorted((int(g), s, int(i)) for g, s, i in want)


# --- nearest neighbours ----------------------------------------------------------------------


def nearest(spark, rows, schema="vec_id long, embedding array<float>", **options):
    frame = multiprobe.search_rows(spark.createDataFrame(rows, schema))
    queries = frame.filter(F.col("vec_id") % 20 == 0)
    out = multiprobe.nearest(frame, queries, **options).join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    got = {}
    for r in out.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["vec_id"], r["score"], r["query_id"]))
    return [sorted(v) for v in got.values()]


def recall(got, rows, k):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    place = {i: n for n, i in enumerate(ids)}
    hit = 0
    for found in got:
        q = found[0][3]
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:k]])
        hit += len(want & {f[1] for f in found})
        assert [f[0] for f in found] == list(range(1, k + 1))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, v, score, _ in found:
            assert score == math.fsum(a * b for a, b in zip(x[place[q]], x[place[v]]))
    return hit / (k * len(got))


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_nearest_recall(spark, kind, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 32))
    if kind == "clusters":
        x = rng.standard_normal((40, 32))[rng.integers(0, 40, 4000)] * 3 + x
    if kind == "lengths":
        x *= rng.lognormal(0, 0.7, (4000, 1))
    # Small groups, so that groups and shards are met.
    monkeypatch.setattr(multiprobe, "GROUP_NUMBERS", 20_000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark, rows)
    assert len(got) == 200 and recall(got, rows, 20) >= 0.9


def test_nearest_of_sf_tables(spark, sf_dir):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(nearest(spark, rows), rows, 20) >= 0.9


def test_nearest_with_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 60)] + [(i, [0.5, 0.5]) for i in range(60, 70)]
    got = nearest(spark, rows)
    assert {f[0][3] for f in got} == {20, 40, 60}
    for found in got:
        ids = [f[1] for f in found]
        own = found[0][3]
        if own == 60:
            # A tie of 0.5 with all others: the smallest ids.
            assert ids == list(range(1, 21))
        else:
            assert ids == [i for i in range(1, 22) if i != own][:20]
    # A repeated id: each row leaves out itself only.
    twice = nearest(spark, [(20, [1.0]), (20, [1.0]), (3, [0.5])])
    assert [[f[1] for f in found] for found in twice] == [[20, 3], [20, 3]]


def test_nearest_leaves_out_bad_rows(spark):
    good = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (40, [1.0, 2.0, 3.0])]
    bad = [(60, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (80, None)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({"row": F.lit("x"), "query": F.lit(0), "rank": F.lit(0)})
    rows = multiprobe.search_rows(frame)
    got = multiprobe.nearest(rows, rows.filter("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert nearest(spark, []) == []


# --- conversation repair ---------------------------------------------------------------------


def by_enumeration(rows):
    """The least (cost, audit) over all edits of a few rows, insertions tried up to three in a place."""
    best = None
    choices = [["D"] if f in ("b", "d") else ["K", "R", "D"] for _, f in rows]
    for edits in product(*choices):
        for gaps in product(range(4), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            if best is not None and audit.count("I") * 5 > best[0]:
                continue
            cost = read(audit, rows)
            if cost is not None and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def read(audit, rows):
    """Cost of an audit, None if no choice of roles makes it a dialogue."""
    stage, cost, at = "0", 0, 0
    for e in audit:
        role, fault = (None, "") if e == "I" else rows[at]
        at += e != "I"
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[e] + (5 if fault == "t" and e != "D" else 0)
        if e == "D":
            continue
        nxt = role if e == "K" else {"0": "u", "s": "u", "u": "a", "a": "u"}[stage]
        if nxt not in {"0": "su", "s": "u", "u": "a", "a": "u"}[stage]:
            return None
        stage = nxt
    return cost if stage in "0a" else None


def by_all_spans(spans):
    """A full chart: every span from every split, as textbooks fill it."""
    n = len(spans)
    chart = {(i, i + 1): c for i, c in enumerate(spans)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cells = [conversation_repair.join(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
            assert all(c == cells[0] for c in cells)
            chart[i, i + size] = cells[0]
    return chart[0, n]


def test_parse_against_all_edits():
    draw = random.Random(4)
    for _ in range(60):
        rows = [(draw.choice("suax"), draw.choice(["", "", "", "b", "d", "t"])) for _ in range(draw.randint(1, 4))]
        spans = [conversation_repair.row_cells(r, f) for r, f in rows]
        cells = conversation_repair.parse(spans)
        assert conversation_repair.best_repair(cells) == by_enumeration(rows), rows
        assert by_all_spans(spans) == cells


def test_parse_of_long_rows_against_full_chart():
    draw = random.Random(6)
    for _ in range(5):
        spans = [conversation_repair.row_cells(draw.choice("suax"), draw.choice(["", "", "b", "t"])) for _ in range(24)]
        assert by_all_spans(spans) == conversation_repair.parse(spans)


def walked(rows):
    """Faults, counts, edits and digest of one conversation, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not t else "d" if (role, text) in seen else "t" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    state = {"0": (0, "", [])}

    def insert(state):
        for _ in range(3):
            for p, (c, a, out) in list(state.items()):
                q = {"0": "u", "s": "u", "u": "a", "a": "u"}[p]
                new = (c + 5, a + "I", [*out, ("user" if q == "u" else "assistant") + ":"])
                if q not in state or new[:2] < state[q][:2]:
                    state[q] = new
        return state

    state = insert(state)
    for (_, role, text), fault in zip(rows, faults):
        nxt = {}
        for p, (c, a, out) in state.items():
            moves = [(p, 2, "D", None)]
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                if role[:1] and role[:1] in {"0": "su", "s": "u", "u": "a", "a": "u"}[p]:
                    moves.append((role[0], more, "K", role))
                q = {"0": "u", "s": "u", "u": "a", "a": "u"}[p]
                moves.append((q, 1 + more, "R", "user" if q == "u" else "assistant"))
            for q, cost, e, as_role in moves:
                new = (c + cost, a + e, out if e == "D" else [*out, f"{as_role}:{text}"])
                if q not in nxt or new[:2] < nxt[q][:2]:
                    nxt[q] = new
        state = insert(nxt)
    cost, audit, out = min((state[q] for q in "0a" if q in state), key=lambda v: v[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    heads = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(heads, heads[1:])), "cost": cost, "audit": audit,
        "sha": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def repaired(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"digest": F.lit(1), "place": F.lit(2), "times": F.lit("x")})
    summary, turns = conversation_repair.repair(conversation_repair.as_given(frame))
    digest = {r[0]: r[1] for r in conversation_repair.dialogue_digests(turns).collect()}
    out = {}
    for r in summary.collect():
        out[r["conv_id"]] = {c: r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
        out[r["conv_id"]]["sha"] = digest.get(r["conv_id"], hashlib.sha256(b"").hexdigest())
    return out, turns


def test_repair_against_a_walk(spark):
    draw = random.Random(9)
    texts = ["Yes.", "No!", "why?", "and then", " ", "", "ok. ", "end.\n", "x" * 50_000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(draw.randint(1, 12)):
            rows.append((conv, draw.choice([None, 0, 1, 2, 3, 5, 9]), draw.choice(["system", "user", "assistant", "user", "assistant", "", "tool"]), draw.choice(texts)))
    # One conversation with a third of all rows, cut over many tasks.
    rows += [(99, i // 3, draw.choice(["user", "assistant"]), f"{draw.randint(0, 300)}" + draw.choice([".", ""])) for i in range(3000)]
    got, turns = repaired(spark, rows)
    by_conv = {}
    for c, *r in rows:
        by_conv.setdefault(c, []).append(r)
    assert set(got) == set(by_conv)
    for conv, mine in by_conv.items():
        assert got[conv] == walked(mine), conv
    # The repaired turns alternate, with places without gaps.
    per = {}
    for r in turns.collect():
        per.setdefault(r["conv_id"], []).append((r["place"], r["role"]))
    for conv, listed in per.items():
        listed.sort()
        assert [p for p, _ in listed] == list(range(len(listed)))
        names = "".join(role[0] for _, role in listed).removeprefix("s")
        assert names == "ua" * (len(names) // 2)


def test_repair_of_repeats_and_null(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")] + [(2, None, None, None)] + [(3, 2**62, "user", "A."), (3, -(2**62), "assistant", "B.")]
    got, _ = repaired(spark, rows)
    assert got[1]["duplicate"] == 499 and got[1]["audit"] == "K" + "D" * 499 + "K" and got[1]["illegal"] == 499
    assert (got[2]["blank"], got[2]["audit"], got[2]["gaps"]) == (1, "D", 0)
    assert (got[3]["audit"], got[3]["gaps"]) == ("RR", 2**63 - 1)
    assert repaired(spark, [(4, 2**63 - 1, "user", "A."), (4, -(2**63), "user", "B.")])[0][4]["gaps"] == 0
    assert repaired(spark, [])[0] == {}
