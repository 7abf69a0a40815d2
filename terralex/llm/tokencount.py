"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

A byte-pair encoding has a local test: a token sequence is the encoding of its text exactly if every
pair of neighbours is the encoding of the pair's own text. So the last token of each prefix is the
one token ending there that fits the last token of the shorter prefix before it, and
``count[i] = count[i - len(token)] + 1``. One pass gives the count of every prefix; truncation to a
budget and the cost of any cut are then lookups, and nothing is encoded again.

Pieces never hold the space mark after another character, so a text falls into segments that each
start with their spaces, and prefix counts add up over segments. A task keeps the table of the
segments it has seen (bounded, and only a memory of results).

Nulls: a null text is the empty text, with no token. A null id is carried along. Repeated rows are
counted each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, text_or_empty

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MEMORY = 600_000
#: Beginnings of up to so many characters are remembered.
SHARED_START = 8
ONE = (1,)
SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Prefix token counts under a byte-pair model with byte fallback, identity text and a leading space mark."""

    def __init__(self, path: str, memory: int = MEMORY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # The merge order of a piece is its score; control, unknown and byte pieces are never met in text.
        pieces = [
            (-model.get_score(i), model.id_to_piece(i))
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.names = [p for _, p in sorted(pieces)]
        self.rank = {p: i for i, p in enumerate(self.names)}
        # A piece that its own text does not merge to is never a token.
        self.tokens = {p: i for p, i in self.rank.items() if self.merged(p) == [p]}
        # Lengths of the tokens by their last two characters, longest first; one character is always one.
        lengths: dict[str, set[int]] = {}
        for p in self.tokens:
            if len(p) > 1:
                lengths.setdefault(p[-2:], {1}).add(len(p))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items()}
        self.memory = memory
        self.fits: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}
        self.starts: dict[str, tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best-ranked neighbours merge first, left before right."""
        rank, never = self.rank.get, len(self.names)
        parts = list(text)
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
        return parts

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their joint text."""
        if len(self.fits) > 3 * self.memory:
            self.fits.clear()
        a, b = self.names[left], self.names[right]
        fit = self.fits[left << 16 | right] = a + b not in self.rank and self.merged(a + b) == [a, b]
        return fit

    def segment(self, text: str) -> bytes | list[int]:
        """Token counts of the prefixes of one segment, of 1, 2, ... characters."""
        known = self.seen.get(text)
        if known is None:
            known = self._solve(text)
            if len(text) <= 48:  # four bytes a character at most: the counts fit into bytes
                if len(self.seen) > self.memory:
                    self.seen.clear()
                known = self.seen[text] = bytes(known)
        return known

    def _solve(self, text: str) -> list[int]:
        token_of, fits, lengths, starts = self.tokens.get, self.fits.get, self.lengths.get, self.starts
        if len(starts) > self.memory:
            starts.clear()
        counts: list[int] = []
        last: list[int] = []  # the token that ends each prefix; -1 for a character that is no piece
        for end in range(1, len(text) + 1):
            # Words begin alike: what a short beginning costs is remembered on its own.
            if end <= SHARED_START:
                known = starts.get(text[:end])
                if known is not None:
                    counts.append(known[0])
                    last.append(known[1])
                    continue
            for n in lengths(text[end - 2 : end], ONE) if end > 1 else ONE:
                start = end - n
                if start < 0:
                    continue
                token = token_of(text[start:end])
                if token is None:
                    if n > 1:
                        continue
                    token, cost = -1, len(text[start].encode("utf-8", "surrogatepass"))
                else:
                    cost = 1
                    if start and last[start - 1] >= 0:
                        fit = fits(last[start - 1] << 16 | token)
                        if not (self._fit(last[start - 1], token) if fit is None else fit):
                            continue
                counts.append((counts[start - 1] if start else 0) + cost)
                last.append(token)
                break
            if end <= SHARED_START:
                starts[text[:end]] = (counts[-1], last[-1])
        return counts

    @staticmethod
    def segments(text: str) -> list[str]:
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def total(self, text: str) -> int:
        seen, segment = self.seen, self.segment
        n = 0
        for s in self.segments(text):
            known = seen.get(s)
            n += (segment(s) if known is None else known)[-1]
        return n

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2, ... characters of ``text``."""
        out = np.zeros(len(text) + 1, np.int64)
        base, at = 0, -1  # the leading mark is no character of the text
        for s in self.segments(text):
            counts = self.segment(s)
            for c in counts:
                if at >= 0:
                    out[at + 1] = base + c
                at += 1
            base += counts[-1]
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The process's counter for a model, so that tasks of one worker share what it has solved."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """The most characters such that they, and every shorter prefix, cost at most ``budget`` tokens."""
    over = np.maximum.accumulate(counts)
    return bisect_right(over, budget) - 1


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counter(path).total
        for b in batches:
            n = pa.array([total(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.transform(map_batches, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``steps``: per character of the text one signed byte, the change of the prefix count there.

    ``read_steps`` turns them back into counts; the last one is the whole text's.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            steps = [np.diff(own.prefixes(t.as_py())).astype(np.int8).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(steps, pa.binary())], names=["doc_id", "steps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).transform(map_batches, run, f"doc_id {kind}, steps binary")


def read_steps(steps: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """doc_id and n_chars: how much of each text a budget of tokens holds, from the stored prefix counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [longest_prefix(read_steps(s.as_py()), budget) for s in b.column("steps")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_chars"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", "steps").transform(map_batches, run, f"doc_id {kind}, n_chars bigint")


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
