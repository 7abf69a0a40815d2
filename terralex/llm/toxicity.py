"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

1. A character trigram model is counted over all texts (28 classes: a to z, other letters, boundary).
2. A token with digits or signs among its letters, with letters repeated three times or more, or
   written letter by letter becomes a lattice: every sign offers the letters it may stand for, a run
   offers one or two letters, separators may go. Viterbi decoding under the trigram model with fixed
   channel costs picks the likeliest spelling. Plain tokens have one path, themselves.
3. Features are restored tokens and their prefixes. Those tied to the label are selected on a bounded
   sample of labelled rows (``FIT_ROWS``), where a logistic model is fitted too.

Nulls: a null text is the empty text and gets the score of no feature. A null id is never labelled and
falls into the fold of the empty id. A row without a label, or with a null one, is scored only. A
repeated row is scored each time; of several labels for one id the largest counts. Without labels
of both kinds every score is the smoothed share of toxic labels. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import in_fold, labelled_sample, map_batches, saved, text_or_empty

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
FIT_ROWS = 20_000
FEATURES = 4096
LEAST_DOCS = 4
MEMORY = 300_000

#: What a sign may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = frozenset(" .-_*~'’`·,/")
#: Channel costs, as log probabilities.
AS_SIGN, AS_REPEAT, AS_SEPARATOR, AS_IS = -1.0, -0.5, -0.5, -9.0
CLASSES = 28
BOUNDARY, OTHER = 0, 27
BEAM = 48
#: A longer token is decoded in pieces of so many characters.
PIECE = 64

SPELLED = re.compile(r"(?<!\S)[^\W_](?:[ .*_-][^\W_]){3,}(?=[\s.,!?;:]|$)")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
LEADING, TRAILING = "\"'([{<*«“„#%&.,;:-_~", "\"')]}>*»”“#%&.,;:-_~!?$|"


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int32)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[128:] = OTHER
    return table


def char_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if ord(c) > 127 and c.isalpha() else BOUNDARY


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each class follows two others, over all bytes of all texts; boundaries separate texts."""
    table = _byte_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for t in b.column("text"):
                raw = t.as_buffer()
                for i in range(0, raw.size, 1 << 20):
                    part = table[np.frombuffer(raw, np.uint8)[max(0, i - 2) : i + (1 << 20)]]
                    if not i:
                        part = np.concatenate([[BOUNDARY, BOUNDARY], part])
                    if i + (1 << 20) >= raw.size:
                        part = np.concatenate([part, [BOUNDARY]])
                    total += np.bincount(part[:-2] * CLASSES**2 + part[1:-1] * CLASSES + part[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(text_or_empty().alias("text")).transform(map_batches, run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3, np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(CLASSES, CLASSES, CLASSES)


class Restorer:
    """Viterbi decoding of obfuscated tokens."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=2, keepdims=True)).tolist()

    @staticmethod
    def suspicious(token: str) -> bool:
        return bool(TRIPLE.search(token)) or not token.isalpha() and any(c.isalpha() for c in token)

    @staticmethod
    def lattice(token: str) -> list[list[tuple[int, str, float]]]:
        """Per position the edges leaving it: (length, letters, cost)."""
        edges: list[list[tuple[int, str, float]]] = [[] for _ in token]
        for i, c in enumerate(token):
            run = 1
            while i + run < len(token) and token[i + run] == c:
                run += 1
            letters = c if c.isalpha() else LEET.get(c, "")
            cost = 0.0 if c.isalpha() else AS_SIGN
            for x in letters:
                edges[i].append((1, x, cost))
                if run >= 3 and (not i or token[i - 1] != c):
                    edges[i].append((run, x, cost + AS_REPEAT))
                    edges[i].append((run, x + x, cost + AS_REPEAT))
            if c in SEPARATORS or c == "!":
                edges[i].append((1, "", AS_SEPARATOR))
            elif not c.isalpha():
                edges[i].append((1, c, AS_IS))
        return edges

    def decode(self, token: str) -> str:
        edges, logp = self.lattice(token), self.logp
        at: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(token) + 1)]
        at[0][BOUNDARY, BOUNDARY] = (0.0, "")
        for i, out in enumerate(edges):
            states = at[i]
            if len(states) > BEAM:
                states = dict(sorted(states.items(), key=lambda x: (-x[1][0], x[1][1]))[:BEAM])
            for (a, b), (score, made) in states.items():
                for length, letters, cost in out:
                    s, p, q = score + cost, a, b
                    for x in letters:
                        k = char_class(x)
                        s += logp[p][q][k]
                        p, q = q, k
                    best = at[i + length].get((p, q))
                    if best is None or (s, made + letters) > best:
                        at[i + length][p, q] = (s, made + letters)
        ends = [(s + logp[a][b][BOUNDARY], made) for (a, b), (s, made) in at[-1].items()]
        return max(ends)[1] if ends else token

    def restore(self, raw: str) -> list[str]:
        """The words a raw token stands for; decoded where it looks obfuscated."""
        token = raw.lstrip(LEADING).rstrip(TRAILING)
        if not token:
            return []
        if not self.suspicious(token):
            return [token]
        decoded = "".join(self.decode(token[i : i + PIECE]) for i in range(0, len(token), PIECE))
        return [w for w in decoded.split() if w]


def features_of(word: str) -> list[str]:
    """A word and its longer prefixes; the mark keeps prefixes apart from words."""
    return [word] + [f"{word[:n]}~" for n in (4, 5, 6) if len(word) > n]


class Reader:
    """From a text to its selected features, with a bounded memory of tokens seen."""

    def __init__(self, counts: np.ndarray, selected: dict[str, int] | None = None):
        self.restorer, self.selected = Restorer(counts), selected or {}
        self.telling: dict[str, tuple[int, ...]] = {}
        self.known: set[str] = set()

    def raw_tokens(self, text: str) -> set[str]:
        lowered = text.lower()
        found = set(lowered.split())
        for m in SPELLED.finditer(lowered):
            span = m.group()
            found.update(span[i : i + PIECE] for i in range(0, len(span), PIECE))
        return found

    def words(self, text: str) -> set[str]:
        restore = self.restorer.restore
        return {w for t in self.raw_tokens(text) for w in restore(t)}

    def features(self, text: str) -> list[int]:
        tokens = self.raw_tokens(text)
        new = tokens - self.known
        if new:
            if len(self.known) > MEMORY:
                self.known, self.telling = set(), {}
                new = tokens
            for t in new:
                ids = {self.selected[f] for w in self.restorer.restore(t) for f in features_of(w) if f in self.selected}
                if ids:
                    self.telling[t] = tuple(sorted(ids))
            self.known |= new
        out: set[int] = set()
        for t in tokens & self.telling.keys():
            out.update(self.telling[t])
        return sorted(out)


def select_features(sample: DataFrame, counts: np.ndarray, most: int = FEATURES) -> list[str]:
    """Features most tied to the label by chi-square over the sample's rows, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts)
        pos, neg = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column("text"), b.column("label")):
                (pos if y.as_py() else neg).update({f for w in reader.words(t.as_py()) for f in features_of(w)})
            if len(pos) + len(neg) > 4 * MEMORY:
                yield from flush(pos, neg)
        yield from flush(pos, neg)

    def flush(pos: Counter, neg: Counter) -> Iterator[pa.RecordBatch]:
        names = list(pos.keys() | neg.keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([pos[f] for f in part], pa.int64()), pa.array([neg[f] for f in part], pa.int64())],
                names=["feature", "pos", "neg"],
            )
        pos.clear()
        neg.clear()

    n_pos, n_neg = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n_pos or not n_neg:
        return []
    summed = sample.transform(map_batches, run, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = n_pos + n_neg
    both = F.col("pos") + F.col("neg")
    gap = F.col("pos") * F.lit(float(n_neg)) - F.col("neg") * F.lit(float(n_pos))
    chi2 = F.pow(gap, F.lit(2.0)) * n / (F.lit(float(n_pos) * n_neg) * both * F.greatest(n - both, F.lit(1)))
    picked = summed.filter(both >= LEAST_DOCS).withColumn("chi2", chi2).filter("chi2 > 12").orderBy(F.desc("chi2"), "feature").limit(most)
    return [r["feature"] for r in picked.select("feature").collect()]


def fit_logistic(ids: np.ndarray, lengths: np.ndarray, y: np.ndarray, size: int, ridge: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for binary features by accelerated full-batch gradient steps.

    ``ids`` has the features of the rows one after the other, ``lengths`` how many each row has.
    """
    n = max(1, len(y))
    at = np.repeat(np.arange(len(lengths)), lengths)
    share = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    if not len(ids):
        return w, b
    vw, vb = w.copy(), b
    # Rare features matter as much as common ones: steps are scaled by each feature's frequency.
    scale = 4.0 / (np.bincount(ids, minlength=size) / n * max(1, len(ids) / n) + ridge / n + 1e-3)
    pw, pb = w, b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, vw[ids], minlength=n) + vb, -30, 30)))
        g = (p - y) / n
        nw = vw - scale * (np.bincount(ids, g[at], minlength=size) + ridge / n * vw) * 0.5
        nb = vb - 2.0 * g.sum()
        m = k / (k + 3)
        vw, vb = nw + m * (nw - pw), nb + m * (nb - pb)
        pw, pb = nw, nb
    return pw, float(pb)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; ``labels`` has doc_id and toxic."""
    scored = _scored(docs.select("doc_id", F.struct("doc_id").alias("_row"), text_or_empty().alias("text")), docs, labels, fit_rows)
    return scored.select(
        "_row.doc_id",
        in_fold("_row.doc_id", FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), text_or_empty().alias("text"))
    return _scored(rows, docs, labels, FIT_ROWS).filter(F.col("score") < threshold).select("_row.*")


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    counts = trigram_counts(docs)
    sample = saved(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, fit_rows), "toxicity-sample")
    names = select_features(sample, counts)
    selected = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts, selected)
        for b in batches:
            ids = [reader.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(ids, pa.list_(pa.int32()))], names=["label", "ids"])

    fitted = sample.transform(map_batches, present, "label int, ids array<int>").toArrow()
    lists = pa.concat_arrays([*fitted["ids"].chunks, pa.array([], pa.list_(pa.int32()))])
    lengths = np.diff(lists.offsets.to_numpy())
    weights, bias = fit_logistic(lists.flatten().to_numpy(), lengths, fitted["label"].to_numpy().astype(float), len(names))
    del fitted, lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts, selected)
        for b in batches:
            z = np.array([bias + weights[reader.features(t.as_py())].sum() for t in b.column("text")])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(score, pa.float64())], names=["_row", "score"])

    out = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("score", T.DoubleType())])
    return rows.select("_row", "text").transform(map_batches, run, out)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
