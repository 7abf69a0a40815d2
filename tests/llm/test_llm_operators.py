"""Training-data operators against brute force, planted cases and edge frames."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terralex.llm import decontamination, embeddings, language_model, mixing, pii, quality, sharding, simhash, tokencount, toxicity
from terralex.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 3000 + "x" * 20000

EDGE = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, "one two three four five six", None, "a", 27),
    (3, "one two three four five six", None, "a", 27),
    (4, "one two three four five six", "en", "b", 27),
    (5, LONG, "en", "b", len(LONG)),
    (None, "no id here", "en", None, 10),
    (6, " \t\n ", "en", "a", 4),
]


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with names used inside."""
    return spark.createDataFrame(EDGE, DOCS).withColumns({"size": F.lit("mine"), "shard": F.lit(-1), "score": F.lit("x"), "_row": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    want = union_find({n for e in edges for n in e}, edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


# 1 mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_share_the_excess():
    def brute(sizes, weights, share, ceiling):
        left, full = share * sum(sizes), set()
        while True:
            free = [i for i in range(len(sizes)) if i not in full]
            rest = left - sum(ceiling * sizes[i] for i in full)
            total = sum(weights[i] for i in free)
            out = {i: rest * weights[i] / total for i in free}
            over = {i for i in free if out[i] >= ceiling * sizes[i]}
            if not over:
                return [ceiling * s if i in full else out[i] for i, s in enumerate(sizes)]
            full |= over

    test_targets_share_the_excess.brute = brute
    assert brute([10, 1000, 1000], [5, 2, 1], 1.5, 2.0)[0] == 20


def test_mix_matches_its_targets(spark, docs):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes)
    test_targets_share_the_excess()
    want = dict(zip(names, test_targets_share_the_excess.brute([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for n in names:
        assert abs(taken[n] - want[n]) <= 2 * mixing.BLOCK_WORDS * max(1, -(-sum(sizes.values()) // mixing.SHARD_WORDS))
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_quotas_are_highest_quotients(spark):
    rng = random.Random(5)
    cells = [(s, k, 100, float(rng.choice([0, 3, 50, 50, 700, 9000]) + rng.random() * (s % 2))) for s in range(6) for k in range(9)]
    got = {(r["shard"], r["source_no"]): r["quota"] for r in mixing.shard_quotas(spark.createDataFrame(cells, "shard bigint, source_no bigint, words bigint, votes double"), 16).collect()}
    for s in range(6):
        votes = {k: v for sh, k, _, v in cells if sh == s}
        seats = math.floor(sum(votes.values()) / 16 + 0.5)
        quotients = sorted(((-v / (2 * n - 1), k, n) for k, v in votes.items() if v for n in range(1, seats + 1)))[:seats]
        want = Counter(k for _, k, _ in quotients)
        assert {k: got[s, k] for k in votes} == {k: want.get(k, 0) for k in votes}


def test_mix_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and {r["source"] for r in got} == {"a", "b", None}
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 6))
    rows = mixing.mixed_documents(edge)
    assert rows.columns == edge.columns and {r["doc_id"] for r in rows.collect()} >= {1, 2, 6}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# 2 tokens


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.model_path())


def test_every_prefix_count(library):
    own = tokencount.PrefixCounter(tokencount.model_path(), memory=50)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz  ▁éñ日\U0001f600\n\t0123456789<>.,THE"
    cases = ["", " ", "   x   y", "</s><unk><0x0A>", "\x00a", "a" * 100, "日本語"]
    cases += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    for t in cases:
        want = [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        assert list(own.prefixes(t)) == want and own.total(t) == want[-1]


def test_token_counts_and_budgets(docs, texts, library, edge, empty):
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs, limit=500).collect()}
    for i, t in texts.items():
        n = len(library.encode(t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 500)
    table = tokencount.prefix_table(docs.limit(20))
    for r in tokencount.truncated(table, 100).collect():
        t = texts[r["doc_id"]]
        assert len(library.encode(t[: r["n_chars"]])) <= 100
        assert r["n_chars"] == len(t) or len(library.encode(t[: r["n_chars"] + 1])) > 100
    assert sorted(r["n_tokens"] for r in tokencount.token_counts(edge).collect() if r["doc_id"] in (1, 2)) == [0, 0]
    assert tokencount.token_counts(empty).count() == 0


# 3 sharding


def test_shards_are_even_and_gapless(docs, spark):
    got = sharding.shard_documents(docs, 8).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert len(got) == docs.count() and set(by) == set(range(8))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 8) <= 2 * largest


def test_hot_texts_are_cut_by_id(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    got = Counter(r["shard"] for r in sharding.shard_documents(rows, 4).collect())
    assert sorted(got) == [0, 1, 2, 3] and max(got.values()) - min(got.values()) <= 20
    few = spark.createDataFrame([(i, f"text {i // 3} " * 30) for i in range(3000)], "doc_id bigint, text string")
    shards = defaultdict(set)
    for r in sharding.shard_documents(few, 6).collect():
        shards[r["text"]].add(r["shard"])
    assert max(map(len, shards.values())) == 1


def test_shard_edges(edge, empty, spark):
    got = sharding.shard_documents(edge, 3)
    assert got.count() == len(EDGE) and "score" in got.columns and got.columns.count("shard") == 1
    assert {r["size"] for r in got.filter("doc_id in (1, 2)").collect()} == {8}
    assert sharding.shard_documents(empty).count() == 0


# 4 toxicity


def test_restores_obfuscated_words(docs, spark):
    spoken = spark.createDataFrame([(i, "you are an idiot and a moron, what a pathetic loser with stupid trash") for i in range(30)], "doc_id bigint, text string")
    fixer = toxicity.Restorer(toxicity.trigram_counts(docs.select("doc_id", "text").unionByName(spoken)))
    for raw, want in {"1d10t": "idiot", "m0r0n": "moron", "l0s3r!!": "loser", "i.d.i.o.t": "idiot", "p@thet1c": "pathetic", "stuuuupid": "stupid", "plain,": "plain", "2024": "2024"}.items():
        assert fixer.restore(raw) == [want]
    assert "idiot" in toxicity.Reader(fixer_counts(fixer)).words("such an i d i o t, he is")


def fixer_counts(fixer):
    return np.exp(np.array(fixer.logp)) * 1e6


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    clean = [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    toxic = [r for r in got if r["toxic"]]
    assert np.mean([r["score"] for r in toxic]) > np.mean([r["score"] for r in clean]) + 0.2


def test_toxicity_edges(edge, empty, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 < r["score"] < 1 for r in got)
    assert toxicity.without_toxic(edge, labels).columns == edge.columns
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(edge, labels.limit(0)).count() == len(EDGE)


# 5 SimHash


def brute_print(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs.limit(60)).collect()}
    assert all(v == brute_print(texts[i]) for i, v in got.items())
    assert simhash.fingerprint("One TWO thrÉe") == brute_print("One TWO thrÉe")


@pytest.mark.parametrize("crowd", [1, 6, 64])
def test_links_within_radius(spark, crowd):
    rng = random.Random(crowd)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 8])):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 4]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), crowd=crowd)
    got = [tuple(r) for r in links.collect()]
    assert union_find(prints, got) == union_find(prints, near)


def test_exploded_fingerprints_are_not_broadcast(spark):
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in range(200)], "fp bigint"), crowd=4)
    plan = links._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:|+-]*", line)[0]) for line in plan]
    sent = [i for i, line in enumerate(plan) if "BroadcastExchange" in line]
    below = [line for i in sent for j, line in enumerate(plan[i + 1 :], i + 1) if all(d > depth[i] for d in depth[i + 1 : j + 1])]
    assert any("Generate explode" in line for line in plan) and not any("Generate explode" in line for line in below)


def test_simhash_edges(edge, empty):
    got = simhash.near_groups(edge).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["component_id"]].add(r["doc_id"])
    assert len(got) == len(EDGE) and groups[1] == {1, 2, 6} and groups[3] == {3, 4}
    kept = simhash.first_of_groups(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (True, None)]
    assert simhash.near_groups(empty).count() == 0 and simhash.first_of_groups(empty).count() == 0


# 6 language model


def test_language_model(docs, texts):
    got = {r["doc_id"]: r for r in language_model.score_documents(docs, size=1 << 20).collect()}
    cut = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b""] for i, t in texts.items()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in cut.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in cut.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(ws), n)
        assert r["n_known"] == sum(w in counts for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    outside = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in outside) > 1.02 * sum(r["base_score"] for r in outside)


def test_filter_holds_log_counts(spark):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    counts = np.maximum(2, (rng.pareto(1, len(keys)) * 3).astype(np.int64))
    keys = np.unique(language_model._trim(keys, 6))
    counts = counts[: len(keys)]
    blobs = [b.to_pylist() for b in language_model._blobs(keys, counts, 6)]
    entries = spark.createDataFrame([(r["bucket"], bytearray(r["keys"]), bytearray(r["counts"])) for b in blobs for r in b], "bucket int, keys binary, counts binary")
    f = language_model.build_filter(entries, 6, 1 << 16)
    guess = f.estimate(keys)
    assert f.floor == 2 and (guess >= counts / language_model.BASE - 1e-9).all()
    assert (guess <= counts * 1.0001).mean() > 0.95
    assert (f.estimate(rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.05
    assert language_model.build_filter(entries, 6, 1 << 12).floor > 2


def test_a_bucket_of_pairs_and_words_is_one_row(spark):
    rows = spark.createDataFrame([("a b a b",), ("a b",), ("",)], "text string").repartition(3)
    vocabulary = language_model.word_counts(rows)
    buckets = language_model.key_counts(rows, vocabulary, 6).collect()
    assert len({r["bucket"] for r in buckets}) == len(buckets)
    got = Counter()
    for r in buckets:
        keys, counts = language_model._read_blobs(pa.table({k: [r[k]] for k in ("bucket", "keys", "counts")}), 6)
        got.update(dict(zip(keys.tolist(), counts.tolist())))
    h = lambda *w: [np.array([language_model._word_hash(x)], np.uint64) for x in w]
    trim = lambda k: int(language_model._trim(k, 6)[0])
    want = {trim(language_model.unigram_keys(*h(w))): n for w, n in ((b"a", 3), (b"b", 3), (b"", 3))}
    # Every text is framed by ends.
    want |= {trim(language_model.pair_keys(*h(*p))): n for p, n in (((b"", b"a"), 2), ((b"a", b"b"), 3), ((b"b", b"a"), 1), ((b"b", b""), 2), ((b"", b""), 1))}
    assert got == want


def test_filter_probes_equal_keys_alike():
    rng = np.random.default_rng(5)
    f = language_model.CountFilter(rng.integers(0, 256, 1 << 12).astype(np.uint8) | rng.integers(0, 256, 1 << 12).astype(np.uint8), 6, 1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)[rng.integers(0, 300, 2000)]
    assert (f.estimate(keys) == np.concatenate([f.estimate(k[None]) for k in keys])).all()
    assert f.estimate(keys[:0]).shape == (0,) and (f.estimate(keys) > 0).any()


def test_entered_keys_are_not_probed_on_the_first_level(spark, monkeypatch):
    rng = np.random.default_rng(8)
    keys = np.unique(language_model._trim(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2), 6))
    counts = rng.integers(1, 60, len(keys))
    entries = spark.createDataFrame([r for b in language_model._blobs(keys, counts, 6) for r in b.to_pylist()], language_model.BLOBS)
    for f in (language_model.build_filter(entries, 6, None, 1), language_model.build_filter(entries, 6, 1 << 12, 1)):
        asked = np.concatenate([keys, keys[:50], rng.integers(0, 2**63, 3000).astype(np.uint64)])
        entered = np.arange(len(asked)) % 3 > 0
        entered[len(keys) + 50 :] = False
        probes, places = [], language_model.CountFilter.places
        monkeypatch.setattr(language_model.CountFilter, "places", staticmethod(lambda k, j, n, s: probes.append((j, n, len(k))) or places(k, j, n, s)))
        assert (f.estimate(asked, entered) == f.estimate(asked)).all()
        once, plain = ([n for j, h, n in probes if (j, h) == (1, 0)])
        assert once < plain if f.floor == 1 else once == plain
        monkeypatch.setattr(language_model.CountFilter, "places", staticmethod(places))


def test_words_that_follow_nothing_take_one_logarithm(monkeypatch):
    rng = np.random.default_rng(6)
    unigram, group = rng.uniform(1e-6, 1e-2, 1000), rng.integers(0, 5, 1000)
    follow = np.where(rng.random(1000) < 0.7, 0.0, rng.random(1000))
    terms = np.log10(language_model.GRID * follow[:, None] + (1 - language_model.GRID) * unigram[:, None])
    taken, log = [], np.log
    monkeypatch.setattr(np, "log", lambda x: taken.append(np.size(x)) or log(x))
    got = language_model.by_weight(unigram, follow, group, 6)
    assert sum(taken) <= (follow == 0).sum() + len(language_model.GRID) * ((follow > 0).sum() + 1) + 1
    assert np.allclose(got, [terms[group == g].sum(0) for g in range(6)], rtol=1e-12, atol=0)


def test_words_are_looked_up_alike(monkeypatch):
    monkeypatch.setattr(language_model, "MEMORY", 30)
    rng = random.Random(7)
    head = {b"w%d" % i: i for i in range(40)}
    words_ = language_model.Words(head)
    for _ in range(40):
        tokens = [b"w%d" % rng.randrange(80) for _ in range(rng.randint(0, 25))]
        at = words_.look_up(tokens)
        assert words_.hashes[at].tolist() == [language_model._word_hash(t) for t in tokens]
        assert words_.counts[at].tolist() == [head.get(t, -1) for t in tokens]


def test_filter_follows_the_corpus_and_every_row_tunes(docs, texts):
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    cut = {i: language_model.words_of(t) + [b""] for i, t in texts.items()}
    counts, pairs = Counter(), Counter()
    for i, ws in cut.items():
        if not held[i]:
            counts.update(ws)
            pairs.update(zip([b"", *ws[:-1]], ws))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model, _ = language_model.train(rows.filter(~language_model.in_fold("doc_id", 7, 2)))
    keys = language_model.pair_keys(*(np.array([language_model._word_hash(p[k]) for p in pairs], np.uint64) for k in (0, 1)))
    guess, true = model.counts.estimate(keys), np.array(list(pairs.values()))
    assert model.counts.floor == 1 and (true == 1).any() and (guess >= np.maximum(1, true / language_model.BASE) - 1e-9).all()
    assert (guess <= true).mean() > 0.95
    levels = language_model.levels_of(np.concatenate([true, list(counts.values())]), 1).sum()
    assert len(model.counts.data) * 8 >= 2 * language_model.HASHES * levels

    space = sum(counts.values()) + len(counts) + 1
    quantised = dict(zip(pairs, guess))

    def frame(i, own):
        for a, b in zip([b"", *cut[i][:-1]], cut[i]):
            seen = counts[a] - own
            slot = int(min(max(math.log2(max(seen, 1)) / 2, 0), language_model.BINS - 1))
            n = min(quantised.get((a, b), 0.0), counts[a])
            yield (counts[b] + 1) / space, max(n - own, 0) / max(seen, 1), slot, seen > 0

    sums = np.zeros((language_model.BINS, len(language_model.GRID)))
    for i in texts:
        if not held[i]:
            for unigram, follow, slot, known in frame(i, 1):
                if known:
                    sums[slot] += np.log10(language_model.GRID * follow + (1 - language_model.GRID) * unigram)
    weights = language_model.GRID[sums.argmax(1)]
    got = {r["doc_id"]: r["score"] for r in language_model.score_documents(docs).collect()}
    for i in texts:
        if not held[i]:
            want = sum(math.log10(weights[k] * f + (1 - weights[k]) * u) if known else math.log10(u) for u, f, k, known in frame(i, 0))
            assert got[i] == pytest.approx(want)


def test_no_filter_reaches_the_driver(spark, docs, edge, monkeypatch):
    rows = lambda df: sorted(map(repr, ((*r[:5], *(f"{x:.9g}" for x in r[5:])) for r in language_model.score_documents(df).collect())))
    some = docs.filter("doc_id % 5 = 0").select("doc_id", "text")
    some = some.unionAll(some.limit(3)).unionAll(edge.select("doc_id", "text"))
    want = rows(some)

    def gathered(*_):
        raise AssertionError("the filter grows with the corpus")

    monkeypatch.setattr(language_model, "build_filter", gathered)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", gathered)
    # Texts cut into many stacks, some longer than a stack.
    monkeypatch.setattr(language_model, "FLUSH_KEYS", 300)
    monkeypatch.setattr(language_model, "FLUSH_ROWS", 3)
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 100)
    assert rows(some) == want


def test_answers_are_exact_counts_and_levels(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FLUSH_ROWS", 2)
    texts = [("A b a b", False), ("a\u00a0b c", False), ("", False), ("a b zz", True), ("a b", False)]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(texts)], "doc_id long, text string, held_out boolean").coalesce(1)
    stacked = language_model.stacks(rows).cache()
    assert [r["doc_id"] for r in stacked.orderBy("stack").collect()] == [[0, 1], [2, 3], [4]]
    answered = language_model.answers(language_model.asks(stacked, 6), 6).cache()
    cut = [([b"", *language_model.words_of(t), b""], h) for t, h in texts]
    counts = Counter(w for ws, h in cut if not h for w in ws[1:])
    pairs = Counter(p for ws, h in cut if not h for p in zip(ws, ws[1:]))
    assert {bytes(r["word"]): r["n"] for r in language_model.vocabulary_of(answered).collect()} == counts
    held = stacked.toArrow()
    for row in (held.slice(i, 1) for i in range(len(held))):
        s = language_model.Stack(row, 6)
        told = sorted((r for r in answered.collect() if r["stack"] == row["stack"][0].as_py()), key=lambda r: r["bucket"])
        totals = np.concatenate([np.frombuffer(r["totals"], np.int64) for r in told])
        assert totals.tolist() == [counts[s.words[i]] for i in s.order.tolist()]
        levels = dict(zip(np.unique(s.pair_keys).tolist(), np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in told]).tolist()))
        words = [s.words[i] for i in s.ids.tolist()]
        for pair, key in zip(zip([b"", *words], words), s.pair_keys.tolist()):
            assert levels[key] >= language_model.levels_of(np.array([pairs[pair]]), 1)[0]
    stacked.unpersist(), answered.unpersist()


def test_language_model_edges(edge, empty):
    got = language_model.score_documents(edge, size=1 << 16).collect()
    assert len(got) == len(EDGE) and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 6))
    assert language_model.score_documents(empty, size=1 << 16).count() == 0


# 7 embeddings


def test_lattice_points():
    x = np.random.default_rng(1).standard_normal((300, 8)) * 2
    p = embeddings.decode_e8(x)
    whole, half = np.all(p == np.rint(p), 1), np.all(p - 0.5 == np.rint(p - 0.5), 1)
    assert (whole | half).all() and (p.sum(1) % 2 == 0).all()
    steps = embeddings.roots()
    assert len(steps) == 240 and (((x[:, None] - p[:, None] - steps) ** 2).sum(2) >= ((x - p) ** 2).sum(1)[:, None] - 1e-9).all()


def brute_links(rows):
    edges, links = [], Counter()
    for i, (a, va, la) in enumerate(rows):
        for b, vb, lb in rows[i + 1 :]:
            if la == lb and va @ vb / math.sqrt((va @ va) * (vb @ vb)) >= 0.93:
                edges.append((a, b))
                links[a] += 1
                links[b] += 1
    return union_find([r[0] for r in rows], edges), links


def test_embedding_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(250):
        v = rng.standard_normal(64)
        v /= np.linalg.norm(v)
        w = rng.standard_normal(64)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = rng.uniform(0.932, 0.97)
        rows += [v, c * v + math.sqrt(1 - c * c) * w]
    rows = [(i, v.astype(np.float32), i // 2 % 3) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v.tolist(), l) for i, v, l in rows], "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_links(df).collect()}
    _, links = brute_links([(i, v.astype(float), l) for i, v, l in rows])
    found = sum(min(got[i], n) for i, n in links.items())
    assert found >= 0.9 * sum(links.values()) and all(got[i] <= links[i] for i in got)


def test_embedding_crowds_and_edges(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    center = rng.standard_normal(16)
    rows = [(i, (center + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1) for i in range(60)]
    rows += [(100, [1.0] * 16, 1), (101, [1.0] * 16, 1), (102, [2.0] * 16, 1), (103, [1.0] * 16, 2), (104, [1.0] * 16, None)]
    rows += [(105, None, 1), (106, [0.0] * 16, 1), (107, [float("nan")] * 16, 1), (108, [1.0, None] * 8, 1), (109, [1.0] * 4, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit("mine"))
    got = {r["vec_id"]: r for r in embeddings.embedding_links(df).collect()}
    crowd = [(i, np.array(v, float), l) for i, v, l in rows[:60]]
    roots, links = brute_links(crowd)
    assert all(got[i]["n_links"] == links[i] and got[i]["component_id"] == roots[i] for i in range(60))
    assert [got[i]["n_links"] for i in (100, 101, 102)] == [2, 2, 2] and got[102]["component_id"] == 100
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(103, 110)) and got[None]["component_id"] is None
    assert embeddings.embedding_links(df.limit(0)).count() == 0


# 8 quality


def test_passages_do_not_depend_on_company():
    texts_ = ["", "one two", "A  b\n" * 100, "éé ß!", " lead", "x" * 500]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts_]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]])
    x, owner = quality.encode(np.concatenate(raw), starts)
    steps = slice(quality.N_SHARES, quality.N_SHARES + quality.N_STEPS)
    for i, r in enumerate(raw):
        alone, _ = quality.encode(r, np.array([0]))
        mine = x[owner == i]
        assert mine.shape == alone.shape
        keep = np.ones(quality.N_FEATURES, bool)
        keep[steps] = False
        assert np.allclose(mine[:, keep], alone[:, keep])


def test_attention_gradient():
    rng = np.random.default_rng(0)
    model = quality.Attention.start(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), 0.4)
    model.p["c"] = rng.standard_normal(quality.HIDDEN)
    x, owner, y = rng.standard_normal((7, quality.N_FEATURES)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, owner, 3)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = model.gradient(x, owner, y)
    for name in ("V", "U", "w", "c", "E"):
        at = tuple(0 for _ in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-3)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in got])
    assert right > 0.93
    good = [r for r in got if r["quality"]]
    assert np.mean([r["predicted"] for r in good]) > 0.97


def test_quality_edges(edge, empty, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (2, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality.score_quality(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(edge, labels.limit(0)).count() == len(EDGE)


# 9 personal data


def brute_base(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and pii.luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if ok(kind, m.group())]
    return sorted(out)


def test_base_spans(texts):
    rng = random.Random(2)
    pieces = ["a@b.c", "@", "x.y@z-1.co.uk", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "+", "12", ".", "-", " ", "é", "00", "(", "a"]
    cases = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)] + list(texts.values())
    for t in cases:
        base, _ = pii.spans(t)
        assert [(a, k, b) for a, k, _, b in brute_base(t)] == base


def test_personal_data_table(docs, texts):
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for i, t in texts.items():
        base = brute_base(t)
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, got[i]["spans"].split(",")))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[2] == k for b in base) for k in pii.KINDS]


def test_added_spans(spark):
    rows = [(i, f"call me: +1 (017) 555-77{i % 90 + 10} or mail a{i}@b.com from 10.0.0.{i % 250}, card 4111111111111111") for i in range(200)]
    rows += [(1000, "two cards 4111111111111111 5500005555555559 here"), (1001, "me (at) example (dot) com"), (1002, "number 1234567890123456 and 999.1.1.1 and nothing")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1000]["spans"] == "card:10:26,card:27:43" and got[1000]["n_added"] == 2
    assert got[1002]["spans"] == "" and got[5]["n_added"] == 0


def test_personal_data_edges(edge, empty):
    got = pii.find_personal_data(edge).collect()
    assert len(got) == len(EDGE) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_personal_data(empty).count() == 0


# 10 decontamination


def test_lcs():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(5) for _ in range(rng.randint(0, 15))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.lcs(a, np.array(b, np.int32)) == table[-1][-1]


def test_leaks_found_and_clean_documents_left(spark, docs, texts):
    rng = random.Random(4)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    planted, n = [], 900_000
    for r in items:
        ws = r["text"].split()
        for edits in (0, len(ws) // 10):
            own = list(ws)
            for _ in range(edits):
                own[rng.randrange(len(own) // 2)] = "changed"
            host = texts[rng.choice(list(texts))].split()
            cut = rng.randrange(len(host))
            planted.append((n, " ".join(host[:cut] + own + host[cut:]), r["item_id"]))
            n += 1
    extra = spark.createDataFrame([p[:2] for p in planted], "doc_id bigint, text string")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs.select("doc_id", "text").unionByName(extra), bench).collect()}
    missed = [p for p in planted if (p[0], p[2]) not in got]
    assert len(missed) <= 0.02 * len(planted)
    plain = {w: decontamination.words_of(t) for w, t in texts.items()}
    for doc, item in got:
        if doc in plain:
            words_ = next(decontamination.words_of(r["text"]) for r in items if r["item_id"] == item)
            ids = {w: k for k, w in enumerate(dict.fromkeys(words_))}
            assert decontamination.lcs([ids[w] for w in words_], np.array([ids.get(w, -1) for w in plain[doc]])) >= 0.65 * len(words_)
    exact = {(i, r["item_id"]) for r in items for i, t in texts.items() if r["text"] in t}
    assert exact <= got


def test_no_unedited_copy_is_missed(spark):
    rng = random.Random(12)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(600)]
    filler = [f"f{i}" for i in range(3000)]
    items = [(k, " ".join(rare[12 * k : 12 * k + 12])) for k in range(40)]
    items += [(100 + k, " ".join(rng.sample(common, 12))) for k in range(10)]
    items += [(200, " ".join(rng.choices(filler, k=1000))), (201, " ".join(rng.choices(common + filler, k=300)))]
    docs = [(n, " ".join(rng.choices(common, k=40) + rng.choices(filler, k=200))) for n in range(300)]
    planted = []
    for item, text in items:
        for lead in (0, 7, 31, 45):
            host = rng.sample(rare, 60)
            planted.append((10_000 + len(planted), " ".join([*host[:lead], text, *host[lead:]]), item))
    rows = spark.createDataFrame(docs + [p[:2] for p in planted], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(rows, bench).collect()}
    assert not [(d, i) for d, _, i in planted if (d, i) not in got]


def test_axes_come_from_all_documents(spark):
    rng = random.Random(13)
    # Words 2i and 2i + 1 of a theme stand together in documents, but never in one item.
    themes = [[f"t{k}w{i}" for i in range(16)] for k in range(12)]
    items = [(2 * k + odd, " ".join(theme[odd::2])) for k, theme in enumerate(themes) for odd in (0, 1)]
    docs = [(n, " ".join(rng.sample(themes[rng.randrange(12)], 12) + rng.choices([f"f{i}" for i in range(500)], k=30))) for n in range(4000)]
    rows, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    searcher = next(decontamination.searchers(rows, bench))
    (block,) = searcher.blocks
    assert block.rank == len(items) // 2
    axes = block.table[:, : block.rank] / block.weights[:, None]
    gram = np.zeros((len(axes), len(axes)))
    for text in [t for _, t in docs] + [t for _, t in items]:
        ids = searcher.reader.read(text)
        for i in range(0, len(ids), 32):
            part = [block.column[w] for w in ids[i : i + 32] if w >= 0]
            cols, tf = np.unique([c for c in part if c >= 0], return_counts=True)
            cols = cols.astype(int)
            v = (1 + np.log(tf)) * block.weights[cols]
            gram[np.ix_(cols, cols)] += np.outer(v, v)
    best = np.linalg.eigvalsh(gram)[::-1][: block.rank].sum()
    assert np.trace(axes.T @ gram @ axes) >= 0.999 * best
    # The other half of an item's theme shares no word with it and is near it all the same.
    assert all(block.vectors[k] @ block.vectors[k ^ 1] > 0.3 for k in range(len(items)))


def test_texts_are_read_once_in_a_pass(spark, tmp_path):
    rows = [(n, " ".join(f"w{(n * k) % 89}" for k in range(1, 50))) for n in range(40)]

    def count(batches):
        for b in batches:
            (tmp_path / f"{b.num_rows}-{random.SystemRandom().getrandbits(64)}").touch()
            yield b

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").mapInArrow(count, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id bigint, text string")
    read = lambda: sum(int(p.name.split("-")[0]) for p in tmp_path.iterdir())
    assert [r["doc_id"] for r in decontamination.find_leaks(docs, bench).collect()] == [3] and read() == len(rows)
    assert decontamination.without_leaks(docs, bench).count() == len(rows) - 1 and read() == 2 * len(rows)


def test_items_of_many_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", 1)
    rows = [(n, " ".join(f"w{n * 7 + k}" for k in range(30))) for n in range(12)]
    docs = spark.createDataFrame([*rows, (None, rows[2][1]), (50, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(n, rows[n][1]) for n in (2, 7, 7)], "item_id bigint, text string")
    got = sorted({(r["doc_id"] or -1, r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()})
    assert got == [(-1, 2), (2, 2), (7, 7)]
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11, 50]


def test_products_of_passages_are_summed_once(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 150))) for _ in range(60)]
    items = decontamination.Items([(k, " ".join(rng.sample(vocabulary, 40))) for k in range(6)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    numbered = decontamination.numbered_words(docs, items)
    frequency, passages = decontamination.passage_frequencies(numbered, items)
    halves = [[items.numbers.get(w, -1) for w in t.split()[i : i + 32]] for t in texts for i in range(0, max(1, len(t.split())), 32)]
    assert passages == len(halves)
    assert frequency.tolist() == [sum(w in h for h in halves) for w in range(len(items.numbers))]
    block = decontamination.Block(items, range(len(items.passages)), frequency, passages)
    size = len(block.weights)
    want = np.zeros((size, size))
    for h in halves:
        tf = Counter(int(block.column[w]) for w in h if w >= 0 and block.column[w] >= 0)
        row = np.zeros(size)
        row[list(tf)] = [(1 + math.log(n)) * block.weights[c] for c, n in tf.items()]
        want += np.outer(row, row)
    sparse = decontamination.sparse_passages(numbered, items, [block]).cache()
    edges = np.linspace(0, size, decontamination.SLICES + 1).astype(int)
    for cells in (decontamination.CELLS, 7 * size):
        monkeypatch.setattr(decontamination, "CELLS", cells)
        got = np.zeros((size, size))
        for r in decontamination.gram(sparse, block).collect():
            got[edges[r["slice"]] : edges[r["slice"] + 1]] = np.frombuffer(r["part"], np.float32).reshape(-1, size)
        assert np.allclose(got, np.triu(want), rtol=1e-5)


@pytest.mark.parametrize("cells", [1 << 18, 40])
def test_pieces_held_by_windows(monkeypatch, cells):
    monkeypatch.setattr(decontamination, "CELLS_AT_ONCE", cells)
    rng = random.Random(22)
    items = decontamination.Items([(k, " ".join(f"w{rng.randrange(120)}" for _ in range(rng.randint(3, 90)))) for k in range(30)])
    size = len(items.numbers)
    pieces = decontamination.Pieces(items, np.array([rng.randint(1, 50) for _ in range(size)]), 60)
    parts = [np.array([rng.randrange(-1, size) for _ in range(rng.choice([0, 1, 31, 32, 33, 64, 200]))], np.int16) for _ in range(60)]
    ids, half, first, n = decontamination._halves(parts)
    text = np.repeat(np.arange(len(parts)), np.diff(np.append(first, n)))
    assert n == sum(max(1, -(-len(p) // 32)) for p in parts)
    got = {}
    for w, k, share in pieces.candidates(ids, half, text):
        got[w, k] = max(share, got.get((w, k), 0.0))
    want = {}
    cut = [(k, w) for k, words_ in enumerate(items.words) for w in decontamination.cut_evenly(words_, 32)]
    for t, part in enumerate(parts):
        for i in range(0, max(1, len(part)), 32):
            held = set(part[i : i + 64].tolist())
            for k, own in cut:
                weights = {w: pieces.weights[pieces.column[w]] for w in own if pieces.column[w] >= 0}
                share = sum(x for w, x in weights.items() if w in held) / sum(weights.values())
                if share >= decontamination.CONTAINED:
                    want[first[t] + i // 32, k] = max(share, want.get((first[t] + i // 32, k), 0.0))
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_decontamination_edges(edge, empty, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (None, "nothing of this kind at all anywhere")], "item_id bigint, text string")
    got = decontamination.find_leaks(edge, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(3, 3), (3, 3), (4, 3)]
    left = decontamination.without_leaks(edge, bench)
    assert left.columns == edge.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 5, 6]
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(edge, bench.limit(0)).count() == 0


def test_stages_keep_columns_and_texts_of_repeated_ids(spark):
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(1, 60)) for k in (5, 11)]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (1, texts[1], "b"), (2, texts[0], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    kept = simhash.first_of_groups(docs)
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[2]])
    dealt = sharding.shard_documents(docs, 2)
    assert sorted((r["doc_id"], r["text"], r["k1"]) for r in dealt.collect()) == sorted(rows)
