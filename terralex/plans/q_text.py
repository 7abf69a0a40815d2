"""Registered queries: corpus preparation, skip-gram training, vector similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.functions.scalars import stable_sigmoid
from terralex.functions.vectors import as_doubles
from terralex.operators import embed as em
from terralex.operators import text as tx
from terralex.plans.q_temporal import r6
from terralex.plans.registry import query
from terralex.session import cut_lineage, stored
from terralex.sources.vectors_io import vector_line

WINDOW, NEGATIVES, DIM, SLOTS = 6, 10, 200, 10_000_000

U = "(concat('0x', substr(md5(concat({})), 1, 8))::BIGINT / 4294967296.0)"
SQL_VOCAB = """, cnt AS (SELECT word, count(*) AS count, min(doc_id * 1000000 + pos) AS first FROM corpus GROUP BY word HAVING count(*) >= 12),
top AS (SELECT * FROM cnt ORDER BY count DESC, first LIMIT 20000),
vocab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY count DESC, first) - 1 AS word_id, word, count, count / (SELECT sum(count) FROM top)::DOUBLE AS freq FROM top)
"""
SQL_ENC = SQL_VOCAB + ", enc AS (SELECT c.doc_id, c.pos, v.word_id, v.freq FROM corpus c JOIN vocab v USING (word))\n"
SQL_SUB = (
    SQL_ENC
    + ", sub AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM enc WHERE "
    + U.format("'42:', doc_id, ':', pos")
    + " > greatest(least(1 - sqrt(5e-4 / freq), 1e0), 0e0))\n"
)
SQL_PAIRS = (
    SQL_SUB
    + ", win AS (SELECT *, floor("
    + U.format("'42:w:', doc_id, ':', pos")
    + f""" * {WINDOW}) + 1 AS w FROM sub),
pairs AS MATERIALIZED (SELECT a.doc_id, a.place, b.place - a.place AS shift, a.word_id AS center, b.word_id AS context
  FROM (SELECT *, unnest([s FOR s IN range(-{WINDOW}, {WINDOW} + 1) IF s <> 0]) AS s FROM win) a
  JOIN sub b ON b.doc_id = a.doc_id AND b.place = a.place + a.s WHERE abs(a.s) <= a.w)
"""
)
SQL_SLOTS = (
    SQL_VOCAB
    + f""", shr AS (SELECT word_id, word, pow(count::DOUBLE, 0.75e0) / (SELECT sum(pow(count::DOUBLE, 0.75e0)) FROM vocab) AS s FROM vocab),
cum AS (SELECT word_id, word, sum(CAST(s AS DECIMAL(24,15))) OVER (ORDER BY word_id)::DOUBLE AS c FROM shr),
led AS (SELECT word_id, word, CASE WHEN word_id = (SELECT max(word_id) FROM vocab) THEN {SLOTS}
  ELSE least(word_id + max(CAST(floor({SLOTS} * c) AS BIGINT) + 1 - word_id) OVER (ORDER BY word_id), {SLOTS}) END AS e FROM cum),
slots AS MATERIALIZED (SELECT word_id, word, coalesce(lag(e) OVER (ORDER BY word_id), 0) AS slot_start, e AS slot_end FROM led)
"""
)
SQL_NEGS = (
    SQL_PAIRS
    + SQL_SLOTS[len(SQL_VOCAB):]
    + ", drawn AS (SELECT p.*, d.draw, CAST(floor("
    + U.format("'42:n:', doc_id, ':', place, ':', shift, ':', (draw - 1) // 4").replace("1, 8)", "1 + 8 * ((draw - 1) % 4), 8)")
    + f""" * {SLOTS}) AS BIGINT) AS slot FROM pairs p, (SELECT unnest(range(1, {NEGATIVES} + 1)) AS draw) d),
negs AS MATERIALIZED (SELECT d.center, d.slot, s.word_id AS negative FROM drawn d JOIN (SELECT word_id, unnest(range(slot_start, slot_end)) AS slot FROM slots) s ON d.slot = s.slot)
"""
)
SQL_EX = (
    SQL_NEGS
    + f""", ex AS MATERIALIZED (SELECT center, other, label, count(*) AS times FROM (SELECT center, context AS other, 1 AS label FROM pairs
  UNION ALL SELECT center, negative, 0 FROM negs) GROUP BY ALL),
emb AS MATERIALIZED (SELECT word_id, list((u * 2 - 1) * {DIM ** -0.5} ORDER BY d) AS v, list((w * 2 - 1) * {DIM ** -0.5} ORDER BY d) AS x FROM (SELECT word_id, d, """
    + U.format("'42:v:', word_id, ':', d")
    + " AS u, "
    + U.format("'7:v:', word_id, ':', d")
    + f""" AS w FROM vocab, (SELECT unnest(range({DIM})) AS d)) GROUP BY word_id),
scored AS MATERIALIZED (SELECT e.*, list_dot_product(c.v, o.x) AS dp FROM ex e JOIN emb c ON c.word_id = e.center JOIN emb o ON o.word_id = e.other),
sg AS MATERIALIZED (SELECT *, CASE WHEN dp >= 0 THEN 1 / (1 + exp(-dp)) ELSE exp(dp) / (1 + exp(dp)) END AS sig FROM scored)
"""
)


def vocabulary(t):
    return tx.vocab(t.corpus())


def kept_words(t):
    """The vocabulary, written once: several steps read this small table."""
    return cut_lineage(vocabulary(t))


def sub(t, words, scope="document"):
    """The thinned corpus, written once before it is numbered, as numbering reads it twice."""
    return tx.renumber(stored(tx.subsample(tx.encode(t.corpus(), words)), "thinned"), scope)


def pairs(t, words):
    return tx.skipgram_pairs(sub(t, words), WINDOW)


def slots(words):
    return tx.negative_slots(words, SLOTS)


def examples(t, words, parts):
    p = pairs(t, words)
    return tx.sampled_examples(p, slots(words), NEGATIVES, SLOTS, parts=parts)


def embeddings(v):
    """Both sides random, so that every term of loss and gradient counts."""
    other = em.initial_embeddings(v, DIM, 7).select("word_id", F.col("center_vec").alias("context_vec"))
    return em.initial_embeddings(v, DIM, 42).drop("context_vec").join(other, "word_id")


@query("tokenize", "SELECT doc_id, CAST(pos AS INT) AS pos, word FROM corpus", ("corpus",))
def tokenize(t):
    return t.corpus()


@query("text_corpus_scan", "SELECT doc_id, text FROM documents")
def text_corpus_scan(t):
    return t.read("documents").select("doc_id", "text")


@query("vocab", SQL_VOCAB + "SELECT word_id, word, count, round(freq, 12) AS freq FROM vocab", ("corpus",))
def vocab(t):
    return vocabulary(t).withColumn("freq", F.round("freq", 12))


@query(
    "vocab_coverage",
    SQL_VOCAB
    + """, a AS (SELECT word, count(*) AS n FROM corpus GROUP BY word)
SELECT CAST(sum(CASE WHEN v.word IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS kept_tokens, CAST(sum(n) AS BIGINT) AS total_tokens,
  round(100e0 * sum(CASE WHEN v.word IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) AS token_pct, count(v.word) AS kept_types, count(*) AS total_types,
  round(100e0 * count(v.word) / count(*), 6) AS type_pct FROM a LEFT JOIN vocab v ON v.word = a.word""",
    ("corpus",),
)
def vocab_coverage(t):
    return r6(tx.vocab_coverage(t.corpus(), vocabulary(t)), "token_pct", "type_pct")


@query(
    "oov_check",
    SQL_VOCAB
    + """, bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark)
SELECT word FROM bw WHERE word NOT IN (SELECT word FROM vocab)""",
    ("corpus",),
)
def oov_check(t):
    words = tx.tokenize(t.read("benchmark"), "item_id", "text").select("word").distinct()
    return tx.out_of_vocabulary(words, vocabulary(t))


@query("encode_corpus", SQL_ENC + "SELECT doc_id, CAST(pos AS INT) AS pos, word_id FROM enc", ("corpus",))
def encode_corpus(t):
    return tx.encode(t.corpus(), vocabulary(t)).drop("freq")


@query("subsample_frequent", SQL_SUB + "SELECT doc_id, CAST(pos AS INT) AS pos, word_id, place FROM sub", ("corpus",))
def subsample_frequent(t):
    return sub(t, kept_words(t)).drop("freq")


@query("skipgram_pairs", SQL_PAIRS + "SELECT doc_id, place, shift, center, context FROM pairs", ("corpus",))
def skipgram_pairs(t):
    return pairs(t, kept_words(t)).drop("pos")


@query(
    "skipgram_pairs_corpus",
    SQL_SUB
    + ", num AS MATERIALIZED (SELECT doc_id, pos, word_id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM sub), win AS MATERIALIZED (SELECT *, floor("
    + U.format("'42:w:', doc_id, ':', pos")
    + f""" * {WINDOW}) + 1 AS w FROM num)
SELECT place, s AS shift, word_id AS center, c AS context FROM (SELECT place, word_id, w, unnest([s FOR s IN range(-{WINDOW}, {WINDOW} + 1) IF s <> 0]) AS s,
  unnest([{", ".join(f"lag(word_id, {-s}) OVER o" if s < 0 else f"lead(word_id, {s}) OVER o" for s in range(-WINDOW, WINDOW + 1) if s)}]) AS c
  FROM win WINDOW o AS (ORDER BY place)) WHERE abs(s) <= w AND c IS NOT NULL""",
    ("corpus",),
)
def skipgram_pairs_corpus(t):
    return tx.skipgram_pairs(sub(t, kept_words(t), "corpus"), WINDOW, scope="corpus").select("place", "shift", "center", "context")


@query("negative_slots", SQL_SLOTS + "SELECT word_id, word, slot_start, slot_end FROM slots WHERE slot_end > slot_start", ("corpus",))
def negative_slots(t):
    return slots(vocabulary(t))


@query(
    "negative_samples",
    SQL_NEGS + "SELECT center, count(*) AS draws, CAST(sum(negative) AS BIGINT) AS negative_sum, min(negative) AS negative_min, max(negative) AS negative_max, CAST(sum(slot) AS BIGINT) AS slot_sum FROM negs GROUP BY center",
    ("corpus",),
)
def negative_samples(t):
    words = kept_words(t)
    drawn = tx.negative_samples(pairs(t, words), slots(words), NEGATIVES, SLOTS)
    return drawn.groupBy("center").agg(
        F.count(F.lit(1)).alias("draws"), F.sum("negative").alias("negative_sum"), F.min("negative").alias("negative_min"),
        F.max("negative").alias("negative_max"), F.sum("slot").alias("slot_sum"),
    )


@query(
    "sgns_forward_loss",
    SQL_EX
    + """SELECT round(sum(-ln(CASE WHEN label = 1 THEN sig ELSE 1 - sig END + 1e-7) * times) / sum(CASE WHEN label = 1 THEN times ELSE 0 END), 8) AS loss,
  CAST(sum(CASE WHEN label = 1 THEN times ELSE 0 END) AS BIGINT) AS n_pairs FROM sg""",
    ("corpus",),
)
def sgns_forward_loss(t):
    words = kept_words(t)
    parts = em.parts_for(words.count(), DIM)
    return em.forward_loss(examples(t, words, parts), embeddings(words), parts).withColumn("loss", F.round("loss", 8))


@query(
    "sgns_gradient_step",
    SQL_EX
    + ", gc AS (SELECT center AS word_id, "
    + ", ".join(f"sum((sig - label) * times * u[{d + 1}]) AS c{d}" for d in range(DIM))
    + " FROM sg JOIN (SELECT word_id, x AS u FROM emb) o ON o.word_id = sg.other GROUP BY center), gx AS (SELECT other AS word_id, "
    + ", ".join(f"sum((sig - label) * times * v[{d + 1}]) AS x{d}" for d in range(DIM))
    + " FROM sg JOIN (SELECT word_id, v FROM emb) c ON c.word_id = sg.center GROUP BY other) SELECT word_id, "
    + ", ".join(f"round(v[{d + 1}] - 0.05 * coalesce(c{d}, 0), 6) AS c{d}, round(x[{d + 1}] - 0.05 * coalesce(x{d}, 0), 6) AS x{d}" for d in range(DIM))
    + " FROM emb LEFT JOIN gc USING (word_id) LEFT JOIN gx USING (word_id)",
    ("corpus",),
)
def sgns_gradient_step(t):
    words = kept_words(t)
    parts = em.parts_for(words.count(), DIM)
    out = em.gradient_step(examples(t, words, parts), cut_lineage(embeddings(words)), 0.05, DIM, parts=parts)
    parts = {"c": "center_vec", "x": "context_vec"}
    return out.select("word_id", *[F.round(F.col(v)[d], 6).alias(f"{p}{d}") for d in range(DIM) for p, v in parts.items()])


@query("sgns_train")
def sgns_train(t):
    words = kept_words(t)
    thin = stored(sub(t, words), "placed")
    drawn = lambda epoch: tx.skipgram_pairs(thin, WINDOW, f"42.{epoch}")
    emb, _ = em.train(drawn, slots(words), words, DIM, NEGATIVES, epochs=3, rounds=5, slots=SLOTS, word_cap=4, batch=2048)
    return em.embedding_sum(emb).join(words.select("word_id", "word"), "word_id")


@query(
    "embedding_sum",
    """SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * 2 FOR x IN embedding]), 5) AS total, len(embedding) AS dim FROM embeddings""",
)
def embedding_sum(t):
    both = t.read("embeddings").select(
        F.col("vec_id").alias("word_id"), as_doubles(F.col("embedding")).alias("center_vec"), as_doubles(F.col("embedding")).alias("context_vec")
    )
    out = em.embedding_sum(both)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return out.select(F.col("word_id").alias("vec_id"), F.round(total, 5).alias("total"), F.size("vec").cast("bigint").alias("dim"))


@query(
    "l2_normalize",
    """SELECT vec_id, i AS place, round(CAST(embedding[i + 1] AS DOUBLE) / greatest(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 1e-12), 6) AS v
FROM embeddings, (SELECT unnest(range(64))::INT AS i)""",
)
def l2_normalize(t):
    out = em.normalized(t.read("embeddings"), "vec_id", "embedding")
    return r6(out.select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("place", "v")), "v")


NORMED = """WITH n AS MATERIALIZED (SELECT vec_id AS id, label, [CAST(x AS DOUBLE) / greatest(sqrt(list_sum([CAST(y AS DOUBLE) * CAST(y AS DOUBLE) FOR y IN embedding])), 1e-12) FOR x IN embedding] AS v FROM embeddings),
ord AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM n)
"""


@query(
    "cosine_top_k",
    NORMED
    + """SELECT q.id AS ask, n.id, round(list_dot_product(q.v, n.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, n.v) DESC, n.id) AS rank
FROM ord q JOIN n ON n.id <> q.id WHERE q.r = 1 QUALIFY rank <= 10""",
)
def cosine_top_k(t):
    vectors = t.read("embeddings")
    queries = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    out = em.cosine_top_k(vectors, "vec_id", "embedding", queries, 10)
    return r6(out.withColumn("rank", F.col("rank").cast("bigint")), "score")


@query(
    "analogy_top_k",
    NORMED
    + """, quad AS (SELECT label AS quad, max(id) FILTER (r = 1) AS a, max(id) FILTER (r = 2) AS b, max(id) FILTER (r = 3) AS c, max(id) FILTER (r = 4) AS expected FROM ord GROUP BY label),
aim AS (SELECT q.*, [na.v[i] * -1 + nb.v[i] + nc.v[i] FOR i IN range(1, 65)] AS w FROM quad q JOIN n na ON na.id = a JOIN n nb ON nb.id = b JOIN n nc ON nc.id = c),
s AS (SELECT aim.quad, aim.expected, n.id, row_number() OVER (PARTITION BY aim.quad ORDER BY list_dot_product(aim.w, n.v) DESC, n.id) AS rank
  FROM aim JOIN n ON n.id NOT IN (a, b, c))
SELECT CAST(quad AS BIGINT) AS quad, expected, max(CASE WHEN id = expected THEN 1 ELSE 0 END) AS hit, max(id) FILTER (rank = 1) AS best FROM s WHERE rank <= 5 GROUP BY quad, expected""",
)
def analogy_top_k(t):
    from pyspark.sql import Window

    vectors = t.read("embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    first = vectors.select("label", "vec_id", F.row_number().over(order).alias("r")).filter(F.col("r") <= 4)
    pick = lambda i: F.max(F.when(F.col("r") == i, F.col("vec_id")))
    quads = first.groupBy(F.col("label").cast("bigint").alias("quad")).agg(
        pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"), pick(4).alias("expected")
    )
    return em.analogy_top_k(vectors, "vec_id", "embedding", quads, 5)


@query(
    "embeddings_sink",
    "SELECT vec_id, concat_ws(' ', vec_id::VARCHAR, array_to_string([printf('%.6f', CAST(x AS DOUBLE)) FOR x IN embedding], ' ')) AS line FROM embeddings",
)
def embeddings_sink(t):
    return t.read("embeddings").select("vec_id", vector_line(F.col("vec_id"), as_doubles(F.col("embedding"))).alias("line"))


@query(
    "stable_sigmoid",
    "SELECT event_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS s FROM (SELECT event_id, (value - 100) / 7e0 AS x FROM events)",
)
def sigmoid(t):
    return t.read("events").select("event_id", F.round(stable_sigmoid((F.col("value") - 100) / 7.0), 9).alias("s"))
