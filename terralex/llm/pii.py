"""Personal data by weak supervision.

Base patterns give spans that always stay. Looser patterns propose further candidates: parts of a
match that the base rules drop as a whole (two card numbers side by side, a phone number followed by
an address), written-out mail addresses, and numbers of the right shape only. Five labelers vote on
every candidate, base spans included: shape, validity, gazetteer, boundary and context; each says
yes, no or nothing. Expectation-maximisation over the counts of all vote patterns of all documents
estimates how reliable each labeler is for each kind, without any label. Its posteriors train the final
classifier, a logistic model over kind and votes. A candidate it accepts is added if it keeps its kind's
rule (checksum, range, number of digits); what breaks the rule is a candidate only to learn from.

There are at most 4 x 3^5 vote patterns, so the fit works on that many counts whatever the input.

Nulls: a null text is the empty text, without spans. A null id is carried along. Repeated rows are
handled each. An empty table gives an empty result. All scans are linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, saved, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("shape", "validity", "gazetteer", "boundary", "context")
ACCEPT = 0.5
#: Characters looked at on either side of a span for context.
NEAR = 40

MARK = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Narrower shapes, for the parts of a dropped match.
CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])")
PHONE_PART = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])")
PHONE_SHAPE = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}")
WRITTEN_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?[\[(]at[\])] ?[\w-]{1,63}(?: ?[\[(]dot[\])] ?[\w-]{1,63}){1,4}", re.I)

#: Gazetteers: fixed values of public numbering plans.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es uk eu it nl ch at be pt pl ru cn jp in br us ca au".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
ISSUER_DIGITS = frozenset("3456")
HINTS = {
    EMAIL: re.compile(r"mail|contact|write|@|escrib|schreib|écri", re.I),
    IP: re.compile(r"\bip\b|host|server|address|addr|login", re.I),
    CARD: re.compile(r"card|visa|master|credit|tarjeta|karte|carte|pay", re.I),
    PHONE: re.compile(r"phone|call|tel|fax|mobil|anruf|llam|appel", re.I),
}
AGAINST = re.compile(r"version|v\.|token|key|hash|isbn|serial|order no", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _dotted_quads(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers joined by dots, leftmost first, and whether all are at most 255."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, spot = run.group().split("."), run.start()
        places = []
        for p in parts:
            places.append((spot, p))
            spot += len(p) + 1
        i = 0
        while i + 3 < len(places):
            four = places[i : i + 4]
            if all(p for _, p in four):
                yield four[0][0], four[3][0] + len(four[3][1]), all(_small(p) for _, p in four)
                i += 4
            else:
                i += 1


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and further candidates, each (start, kind, end)."""
    if not MARK.search(text):
        return [], []
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    if "@" in text:
        base += [(a, EMAIL, b) for a, b in _emails(text)]
    for a, b, small in _dotted_quads(text):
        (base if small else more).append((a, IP, b))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 12:
            continue
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            base.append((m.start(), CARD, m.end()))
        else:
            more += [(p.start(), CARD, p.end()) for p in CARD_PART.finditer(text, m.start(), m.end())]
    if "+" in text:
        for m in PLUS.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                base.append((m.start(), PHONE, m.end()))
            else:
                more += [(p.start(), PHONE, p.end()) for p in PHONE_PART.finditer(text, m.start(), m.end())]
    more += [(m.start(), EMAIL, m.end()) for m in WRITTEN_MAIL.finditer(text)]
    return sorted(base), sorted(more)


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 2 yes, 1 no, 0 nothing."""
    span, d = text[start:end], _digits(text[start:end])
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    yes = lambda x: 2 if x else 1
    if kind == EMAIL:
        tail = re.split(r"[.\])\s]+", span)[-1].lower()
        shape = yes(re.fullmatch(r"[\w%+-]+(\.[\w%+-]+)*(@| ?[\[(]at[\])] ?)[\w-]+(( ?[\[(]dot[\])] ?|\.)[\w-]+)+", span, re.I))
        valid = yes(2 <= len(tail) <= 24 and tail.isalpha())
        known = 2 if tail in TOP_DOMAINS else 0
        free = yes(not (right.isalnum() or right == "@"))
    elif kind == IP:
        parts = span.split(".")
        shape = yes(all(len(p) <= 3 for p in parts))
        valid = yes(all(_small(p) for p in parts))
        known = 1 if parts[0] in ("0", "00", "000") else 2 if parts[:2] == ["192", "168"] or parts[0] in ("10", "127") else 0
        free = yes(not (left.isalnum() or left == "." or right.isalnum() or right == "."))
    elif kind == CARD:
        shape = yes(len(d) in (13, 14, 15, 16, 19))
        valid = yes(12 <= len(d) <= 19 and luhn(d))
        known = 2 if d[0] in ISSUER_DIGITS else 0
        free = yes(not (left.isalnum() or right.isalnum() or left in "._-+#" and left or right == "_"))
    else:
        code = re.match(r"\+([0-9]{1,3})", span)
        shape = yes(PHONE_SHAPE.fullmatch(span))
        valid = yes(9 <= len(d) <= 15)
        known = 2 if code and any(code[1][:n] in CALLING_CODES for n in (1, 2, 3)) else 1
        free = yes(not (left.isalnum() or right.isalnum()))
    context = 1 if AGAINST.search(around) else 2 if HINTS[kind].search(around) else 0
    return shape, valid, known, free, context


def _code(v: tuple[int, ...]) -> int:
    n = 0
    for x in v:
        n = 3 * n + x
    return n


def _uncode(n: int) -> list[int]:
    return [n // 3**i % 3 for i in reversed(range(len(LABELERS)))]


def estimate(counts: list[tuple[int, int, float]], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Posterior of every (kind, pattern) from (kind, pattern, count): two hidden classes, independent labelers.

    The yes class starts where yes votes outnumber no votes. Counts are smoothed by one in each cell.
    """
    out: dict[tuple[int, int], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = sorted((p, n) for k, p, n in counts if k == kind)
        v = np.array([_uncode(p) for p, _ in rows])
        n = np.array([c for _, c in rows], float)
        post = np.clip(0.5 + 0.2 * ((v == 2).sum(1) - 2.0 * (v == 1).sum(1)), 0.02, 0.98)
        for _ in range(rounds):
            logit = np.log(((n * post).sum() + 1) / ((n * (1 - post)).sum() + 1)) * np.ones(len(n))
            for j in range(v.shape[1]):
                for x in range(3):
                    at = v[:, j] == x
                    p1 = ((n * post)[at].sum() + (2.0 if x == 2 else 1.0)) / ((n * post).sum() + 4)
                    p0 = ((n * (1 - post))[at].sum() + (2.0 if x == 1 else 1.0)) / ((n * (1 - post)).sum() + 4)
                    logit[at] += np.log(p1 / p0)
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        out.update({(kind, p): float(x) for (p, _), x in zip(rows, post)})
    return out


def train(counts: list[tuple[int, int, float]], posterior: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """The span classifier's score of every pattern: ridge logistic regression on kind and votes, soft labels."""
    if not counts:
        return {}
    x = np.zeros((len(counts), len(KINDS) + 2 * len(LABELERS)))
    y, n = np.zeros(len(counts)), np.zeros(len(counts))
    for i, (kind, pattern, c) in enumerate(counts):
        x[i, kind] = 1
        for j, v in enumerate(_uncode(pattern)):
            if v:
                x[i, len(KINDS) + 2 * j + v - 1] = 1
        y[i], n[i] = posterior[kind, pattern], c
    n = np.log1p(n)  # common patterns do not drown the rare ones
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        hess = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(k, pattern): float(s) for (k, pattern, _), s in zip(counts, p)}


SPAN = "array<struct<start:int,kind:int,end:int,pattern:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: the spans of every row with their vote patterns."""
    spans_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "pattern")]))

    def described(text: str, found: list) -> list:
        return [{"start": a, "kind": k, "end": b, "pattern": _code(votes(text, a, k, b))} for a, k, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for t in batch.column("text"):
                text = t.as_py()
                b, m = spans(text)
                base.append(described(text, b))
                more.append(described(text, m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, spans_type), pa.array(more, spans_type)], names=["doc_id", "base", "more"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).transform(map_batches, run, f"doc_id {kind}, base {SPAN}, more {SPAN}")


def _listed(spans_col) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per document: counts of base spans by kind, the base spans' digest, all spans, and how many were added."""
    found = saved(candidates(docs), "pii-candidates")
    seen = (
        found.select(F.explode(F.concat("base", "more")).alias("s"))
        .groupBy(F.col("s.kind").alias("kind"), F.col("s.pattern").alias("pattern"))
        .count()
        .collect()
    )
    counts = [(r["kind"], r["pattern"], float(r["count"])) for r in sorted(seen, key=lambda r: (r["kind"], r["pattern"]))]
    scores = train(counts, estimate(counts))
    valid = LABELERS.index("validity")
    accepted = sorted(k * 3 ** len(LABELERS) + p for (k, p), s in scores.items() if s >= accept and _uncode(p)[valid] == 2)
    chosen = F.array(*[F.lit(a) for a in accepted]) if accepted else F.array().cast("array<int>")
    added = F.filter("more", lambda s: F.array_contains(chosen, s["kind"] * 3 ** len(LABELERS) + s["pattern"]))
    both = found.withColumn("added", added).withColumn("all_spans", F.array_sort(F.concat("base", "added")))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
