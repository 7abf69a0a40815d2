"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded by the shares of its character
classes, of their transitions, and by how it repeats words. Gated attention weighs the passages,
``a_k ~ exp(w (tanh(V h_k) * sigmoid(U h_k)))``, and the weighted sum of their representations is
scored. All weights are learnt from document labels alone, on a bounded sample of labelled rows
(``FIT_ROWS``); every passage of every text is encoded and scored.

Nulls: a null text is the empty text: one passage of zeros. A null id is never labelled and falls
into the fold of the empty id. A row without a label, or with a null one, is scored only. A repeated
row is scored each time; of several labels for one id the largest counts. Without labels of both
kinds every score is the smoothed share of good labels. An empty table gives an empty result. A text
longer than ``CHUNK`` bytes is encoded in pieces that end at a space; passages start anew there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import in_fold, labelled_sample, map_batches, saved, text_or_empty

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
FIT_ROWS = 6_000
PASSAGE_WORDS = 64
CHUNK = 1 << 20
HIDDEN = 16
EPOCHS = 30
SEED = 5

#: Character classes: the coarse class of each byte, for shares; the first eight also for transitions.
GROUPS = ("lower", "upper", "digit", "space", "stop", "high", "symbol", "newline")
SIGNS = "!%&*#$|@<>{}[]\\/=_~^+\"'-():;?"
N_SHARES = len(GROUPS) + len(SIGNS)
N_STEPS = len(GROUPS) ** 2
N_WORDS = 6
N_FEATURES = N_SHARES + N_STEPS + N_WORDS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    coarse = np.full(256, GROUPS.index("symbol"), np.int64)
    for a, b, g in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        coarse[ord(a) : ord(b) + 1] = g
    coarse[128:] = GROUPS.index("high")
    coarse[[32, 9, 11, 12]] = GROUPS.index("space")
    coarse[[10, 13]] = GROUPS.index("newline")
    coarse[[ord(".") , ord(",")]] = GROUPS.index("stop")
    fine = coarse.copy()
    for i, c in enumerate(SIGNS):
        fine[ord(c)] = len(GROUPS) + i
    return coarse, fine


COARSE, FINE = _tables()
POWERS = np.random.default_rng(99).integers(1, 1 << 62, 64).astype(np.uint64) | np.uint64(1)


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of texts laid end to end in ``data`` (bytes); text i begins at ``starts[i]``.

    Returns the matrix and the text number of each passage. Every text has a passage at least.
    """
    n_texts = len(starts)
    coarse = COARSE[data]
    gap = (coarse == 3) | (coarse == 7)
    begins = ~gap
    begins[1:] &= gap[:-1] | False
    first = starts[starts < len(data)]
    begins[first] = ~gap[first]
    word_at = np.flatnonzero(begins)
    text_of_word = np.searchsorted(starts, word_at, side="right") - 1
    # Empty texts share their start with the next one; the search gives the last, which owns the bytes.
    words_before = np.searchsorted(word_at, starts)
    passage_in_text = (np.arange(len(word_at)) - words_before[text_of_word]) // PASSAGE_WORDS
    per_text = np.zeros(n_texts, np.int64)
    np.maximum.at(per_text, text_of_word, passage_in_text)
    per_text += 1
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.repeat(np.arange(n_texts), per_text)
    n = offsets[-1]
    x = np.zeros((n, N_FEATURES), np.float64)
    if not len(data):
        return x, owner
    word_passage = offsets[text_of_word] + passage_in_text
    # Bytes belong to the passage of the last word begun; those before a text's first word to its first passage.
    word_of_byte = np.cumsum(begins) - 1
    text_of_byte = np.repeat(np.arange(n_texts), np.diff(np.append(starts, len(data))))
    if len(word_at):
        passage = np.where(word_of_byte >= words_before[text_of_byte], word_passage[np.maximum(word_of_byte, 0)], offsets[text_of_byte])
    else:
        passage = offsets[text_of_byte]
    length = np.maximum(1, np.bincount(passage, minlength=n))[:, None]
    x[:, :N_SHARES] = np.bincount(passage * N_SHARES + FINE[data], minlength=n * N_SHARES).reshape(n, -1) / length
    steps = coarse[:-1] * len(GROUPS) + coarse[1:]
    x[:, N_SHARES : N_SHARES + N_STEPS] = np.bincount(passage[:-1] * N_STEPS + steps, minlength=n * N_STEPS).reshape(n, -1) / length
    if len(word_at):
        inside = ~gap
        place = np.minimum(np.arange(len(data)) - word_at[np.maximum(word_of_byte, 0)], 63)
        value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * POWERS[place], np.uint64(0))
        hashes = np.add.reduceat(value, word_at)
        words = np.bincount(word_passage, minlength=n)
        count = np.maximum(1, words)
        chars = np.bincount(word_passage, np.add.reduceat(inside.astype(np.int64), word_at), minlength=n)
        base = N_SHARES + N_STEPS
        for k, lag in enumerate((1, 2, 8)):
            again = (hashes[lag:] == hashes[:-lag]) & (word_passage[lag:] == word_passage[:-lag])
            x[:, base + k] = np.bincount(word_passage[lag:][again], minlength=n) / count
        keys = np.unique(hashes * np.uint64(0x9E3779B97F4A7C15) + word_passage.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)[1]
        x[:, base + 3] = np.bincount(word_passage[keys], minlength=n) / count
        x[:, base + 4] = chars / count / 10
        x[:, base + 5] = np.log1p(words) / 5
    return x, owner


def encoded(texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows of the batch, passage features, place in those rows of each passage), about ``CHUNK`` bytes a time."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.as_buffer(), np.uint8) if t.as_buffer().size else np.empty(0, np.uint8)
        if len(raw) > CHUNK:
            if rows:
                yield rows, *_joined(parts)
                rows, parts, size = [], [], 0
            found = [encode(p, np.array([0]))[0] for p in _pieces(raw)]
            x = np.concatenate(found)
            yield [i], x, np.zeros(len(x), np.int64)
            continue
        rows.append(i)
        parts.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield rows, *_joined(parts)
            rows, parts, size = [], [], 0
    if rows:
        yield rows, *_joined(parts)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return encode(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64))


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            blanks = np.flatnonzero(np.isin(raw[at:end], (32, 10, 9, 13)))
            end = at + blanks[-1] + 1 if len(blanks) else end
        yield raw[at:end]
        at = end


class Attention:
    """Gated attention pooling over passages and a logistic score of the pooled representation."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, mean: np.ndarray, std: np.ndarray, share: float) -> Attention:
        rng = np.random.default_rng(SEED)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        return cls(
            {
                "mean": mean, "std": std,
                "E": draw(len(mean), HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, HIDDEN), "U": draw(HIDDEN, HIDDEN),
                "w": draw(HIDDEN, 1)[:, 0], "c": np.zeros(HIDDEN), "b": np.array([np.log(share / (1 - share))]),
            }
        )

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        h0 = np.clip((x - p["mean"]) / p["std"], -8, 8)
        h = np.tanh(h0 @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (t * s) @ p["w"]
        starts = np.searchsorted(owner, np.arange(n))
        top = np.maximum.reduceat(logit, starts)
        a = np.exp(logit - top[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return {"h0": h0, "h": h, "t": t, "s": s, "a": a, "z": z, "starts": starts, "score": score}

    def gradient(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, owner, len(y))
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        dh = f["a"][:, None] * dz[owner]
        da = (dz[owner] * f["h"]).sum(1)
        mean = np.add.reduceat(f["a"] * da, f["starts"])[owner]
        dl = f["a"] * (da - mean)
        ts = f["t"] * f["s"]
        dt = dl[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = dl[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {
            "E": f["h0"].T @ dpre + 1e-4 * p["E"], "e": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": ts.T @ dl, "c": f["z"].T @ d + 1e-4 * p["c"], "b": np.array([d.sum()]),
        }


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Attention:
    """Adam over batches of documents in a seeded order. ``owner`` is sorted; every document has a passage."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y):
        return Attention.start(np.zeros(N_FEATURES), np.ones(N_FEATURES), share)
    model = Attention.start(x.mean(0), x.std(0) + 1e-4, share)
    if y.min() == y.max():
        return model
    starts = np.append(np.searchsorted(owner, np.arange(len(y))), len(owner))
    rng, step = np.random.default_rng(SEED), 0
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            docs = order[i : i + 128]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            step += 1
            for k, g in model.gradient(x[at], own, y[docs]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - 0.01 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(sample: DataFrame) -> Attention:
    """Train on the bounded sample (doc_id, label, text): encoded where it lies, fitted in one task."""
    passages = T.StructType(
        [T.StructField("doc_id", sample.schema["doc_id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())]
    )

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x, own in encoded(b.column("text")):
                data = [x[own == k].astype(np.float32).tobytes() for k in range(len(rows))]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("label").take(at), pa.array(data, pa.binary())], names=["doc_id", "label", "x"])

    def train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = sorted((str(i.as_py()), y.as_py(), d.as_py()) for b in batches for i, y, d in zip(b.column("doc_id"), b.column("label"), b.column("x")))
        bags = [np.frombuffer(d, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for _, _, d in docs]
        x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES))
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        model = train(x, owner, np.array([y for _, y, _ in docs], float))
        for k, v in model.p.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.ravel().tolist()], pa.list_(pa.float64()))], names=["name", "value"])

    coded = saved(sample.select("doc_id", "label", "text").transform(map_batches, encode_rows, passages), "quality-passages")
    params = {r["name"]: np.array(r["value"]) for r in coded.repartition(1).transform(map_batches, train_rows, "name string, value array<double>").collect()}
    shapes = {"E": (N_FEATURES, HIDDEN), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN)}
    return Attention({k: v.reshape(shapes.get(k, v.shape)) for k, v in params.items()})


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row of ``docs``; ``labels`` has doc_id and quality."""
    sample = saved(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, fit_rows), "quality-sample")
    model = fit(sample)
    out = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x, own in encoded(b.column("text")):
                score = model.forward(x, own, len(rows))["score"]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows)), pa.array(score), pa.array(np.bincount(own, minlength=len(rows)))], names=["doc_id", "score", "n_passages"]
                )

    scored = docs.select("doc_id", text_or_empty().alias("text")).transform(map_batches, run, out)
    return scored.select(
        "doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages"
    )


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
