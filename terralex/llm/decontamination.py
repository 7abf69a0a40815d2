"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of 64 words, half overlapping. In how many passages each benchmark word occurs
   is counted over all documents and gives the inverse-frequency weights. Words in more than
   ``MOST_SHARE`` of the passages are left out of the vectors, but every item keeps its ``RAREST`` rarest.
2. A randomised SVD of the weighted passages of all documents and of the items yields the latent axes:
   tasks sum the products of their sparse passages' words, which are multiplied with the test matrix and its
   products, and only matrices of fixed size meet, summed in slices. Items go in blocks of at most ``BLOCK``, each with its own axes, at most
   ``RANK`` and half as many as the block's passages, so that words that go together share axes.
3. Every passage of every document is projected, and its latent product with every item over the full
   lengths of both is its cosine, or the plain product of shared words if that is larger; passages above
   ``CANDIDATE`` are candidates. Items longer than a window go in passages of their own.
4. So are passages that hold ``CONTAINED`` of the weight of a piece of an item. Pieces have at most
   ``HALF_WINDOW`` words, so an unedited copy lies whole in some window and is never missed, whatever
   words stand around it.
5. A candidate is checked on the words around it: the longest common subsequence with the item covers
   ``LCS`` of it, or a smaller part and also the answer, the item's last sentence.

Words are white-space tokens in lower case without outer punctuation. Texts are read once in a pass: their
words' numbers are saved, at two or four bytes a word, and all further steps read these. Up to ``ITEMS_A_PASS`` items are
searched in one pass over the documents.

Nulls: a null text is the empty text and leaks nothing; a null or wordless item is no item; a null
document id is carried along. Repeated rows are each found. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import map_batches, saved, ship_code, text_or_empty

HALF_WINDOW = 32
BLOCK = 256
RANK = 128
OVERSAMPLE = 8
POWER_ROUNDS = 2
SLICES = 16
ITEMS_A_PASS = 2048
RAREST = 12
MOST_SHARE = 0.01
CANDIDATE = 0.3
CONTAINED = 0.4
LCS, LCS_WITH_ANSWER, ANSWER = 0.8, 0.65, 0.8
#: Rounding may take a little off a half of ``CONTAINED``.
HALF_ENOUGH = CONTAINED / 2 - 1e-9
CELLS = 1 << 24
CELLS_AT_ONCE = 1 << 18
CHUNK_TOKENS = 1 << 17
WINDOWS_AT_ONCE = 1024
MEMORY = 300_000
SEED = 10

OUTER = re.compile(r"^\W+|\W+$")
SENTENCE = re.compile(r"[.!?]+\s+|\n+")


#: What ``OUTER`` cuts off tokens of ASCII alone.
ASCII_OUTER = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")


def word_of(token: str) -> str:
    if token.isalnum():
        return token
    return token.strip(ASCII_OUTER) if token.isascii() else OUTER.sub("", token)


def words_of(text: str) -> list[str]:
    return [w for w in map(word_of, text.lower().split()) if w]


def cut_evenly(words: list[int], most: int) -> list[list[int]]:
    """The words in as few parts of at most ``most`` as possible, of nearly the same length."""
    n = -(-len(words) // most)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


class Items:
    """The items of one pass: word numbers of every item, of its answer, and of its passages with their items' places."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: list = []
        self.words: list[list[int]] = []
        self.answers: list[list[int]] = []
        self.numbers: dict[str, int] = {}
        self.passages: list[tuple[int, list[int]]] = []
        for item, text in rows:
            words = words_of(text)
            if not words:
                continue
            last = [s for s in (words_of(s) for s in SENTENCE.split(text)) if s][-1]
            self.ids.append(item)
            self.words.append([self.numbers.setdefault(w, len(self.numbers)) for w in words])
            self.answers.append([self.numbers[w] for w in last if w in self.numbers])
            self.passages += [(len(self.ids) - 1, w) for w in cut_evenly(self.words[-1], 2 * HALF_WINDOW)]


class Numbers(dict):
    """Word number by raw token: -1 for words of no item, -2 for punctuation; remembers what it has looked up."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, token: str) -> int:
        w = word_of(token)
        n = self[token] = self.numbers.get(w, -1) if w else -2
        return n


class TokenReader:
    """Word numbers of texts, with a bounded memory of the tokens seen that need their punctuation cut."""

    def __init__(self, numbers: dict[str, int]):
        self.known = Numbers(numbers)

    def read(self, text: str) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.known = Numbers(self.known.numbers)
        known, numbers = self.known, self.known.numbers
        # Words of items stand for themselves, and so do letters and digits alone.
        return np.array([numbers[t] if t in numbers else -1 if t.isalnum() else known[t] for t in text.lower().split()], np.int32)

    def words(self, text: str) -> np.ndarray:
        ids = self.read(text)
        return ids[ids > -2]  # tokens of punctuation alone are no words


def _chunks(parts: Iterable[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Places and words of texts, about ``CHUNK_TOKENS`` a time."""
    rows, own, n = [], [], 0
    for i, ids in enumerate(parts):
        rows.append(i)
        own.append(ids)
        n += len(ids)
        if n >= CHUNK_TOKENS:
            yield rows, own
            rows, own, n = [], [], 0
    if rows:
        yield rows, own


def _halves(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Item words of several texts: their numbers, their half windows, the first half of each text, and how many halves."""
    lengths = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-lengths // HALF_WINDOW)))])
    _, place = _spread(np.zeros(len(parts), np.int64), lengths)
    half = np.repeat(first[:-1], lengths) + place // HALF_WINDOW
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    held = ids >= 0
    return ids[held], half[held], first[:-1], int(first[-1])


def numbered_words(rows: DataFrame, items: Items) -> DataFrame:
    """``rows`` with the numbers of their texts' words (``words``) in place of ``text``, read once and saved.

    Every task adds one row that counts the passages holding each word and, at the end, all its passages (``tally``).
    """
    numbers, size, kind = items.numbers, len(items.numbers), _kind(items)
    keys = [f for f in rows.schema if f.name != "text"]
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in keys), T.StructField("words", T.BinaryType()), T.StructField("tally", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TokenReader(numbers)
        total, passages, last = np.zeros(size, np.int64), 0, None
        for b in batches:
            parts = [reader.words(t.as_py()) for t in b.column("text")]
            for _, own in _chunks(parts):
                ids, half, _, n = _halves(own)
                total += np.bincount(np.unique(half.astype(np.int64) * size + ids) % size, minlength=size)
                passages += n
            last = [b.column(f.name) for f in keys]
            words = pa.array([p.astype(kind).tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([*last, words, pa.nulls(len(parts), pa.list_(pa.int64()))], names=out.names)
        if last is not None:
            tally = pa.array([np.append(total, passages)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x.type) for x in last), pa.nulls(1, pa.binary()), tally], names=out.names)

    return saved(rows.transform(map_batches, run, out), "lsa-words")


def _kind(items: Items) -> type:
    return np.int16 if len(items.numbers) < 1 << 15 else np.int32


def _read_words(words: pa.Array, kind: type) -> Iterator[np.ndarray]:
    return (np.frombuffer(w.as_buffer(), kind) for w in words)


def passage_frequencies(numbered: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many passages each word occurs, and the number of passages, over all documents."""
    out = np.zeros(len(items.numbers) + 1, np.int64)
    tallies = numbered.filter("tally IS NOT NULL").select(F.posexplode("tally").alias("word", "n")).filter("n > 0")
    for r in tallies.groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


def _tfidf(ids: np.ndarray, row: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (row, column, value)."""
    size = len(weights)
    key, tf = np.unique(row.astype(np.int64) * size + ids, return_counts=True)
    rows, cols = key // size, key % size
    return rows, cols, (1 + np.log(tf)) * weights[cols]


def _product(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A M) of sparse rows A."""
    out = np.zeros_like(matrix)
    cuts = np.concatenate([[0], 1 + np.flatnonzero(rows[1:] != rows[:-1])])
    for i in range(0, len(cuts), 4096):
        part = cuts[i : i + 4096]
        a, b = part[0], cuts[i + 4096] if i + 4096 < len(cuts) else len(rows)
        y = np.add.reduceat(value[a:b, None] * matrix[cols[a:b]], part - a, axis=0)
        spread = y[np.searchsorted(part, np.arange(a, b), side="right") - 1] * value[a:b, None]
        order = np.argsort(cols[a:b], kind="stable")
        c = cols[a:b][order]
        first = np.concatenate([[0], 1 + np.flatnonzero(c[1:] != c[:-1])])
        out[c[first]] += np.add.reduceat(spread[order], first, axis=0)
    return out


def telling_words(parts: list[list[int]], frequency: np.ndarray, passages: int) -> np.ndarray:
    """The words that stand for some parts of items: the ``RAREST`` of each, and all that few passages have."""
    kept: set[int] = set()
    for part in parts:
        words = sorted(set(part), key=lambda w: (frequency[w], w))
        kept.update(words[:RAREST])
        kept.update(w for w in words[RAREST:] if frequency[w] <= MOST_SHARE * passages)
    return np.array(sorted(kept))


def word_weights(frequency: np.ndarray, passages: int) -> np.ndarray:
    return (np.log((passages + 1) / (frequency + 1)) + 1e-3) ** 2


class Pieces:
    """Short pieces of all items of a pass, found by their words."""

    def __init__(self, items: Items, frequency: np.ndarray, passages: int):
        parts = [(k, w) for k, words in enumerate(items.words) for w in cut_evenly(words, HALF_WINDOW)]
        chosen = telling_words([w for _, w in parts], frequency, passages)
        self.owner = np.array([k for k, _ in parts])
        self.column = np.full(len(items.numbers), -1, np.int32)
        self.column[chosen] = np.arange(len(chosen))
        self.weights = word_weights(frequency[chosen], passages)
        pairs = sorted({(self.column[w], n) for n, (_, words) in enumerate(parts) for w in words if self.column[w] >= 0})
        cols, self.posting = (np.array(x) for x in zip(*pairs))
        self.first = np.searchsorted(cols, np.arange(len(chosen) + 1))
        self.totals = np.bincount(self.posting, self.weights[cols], minlength=len(parts))
        self.words = cols[np.argsort(self.posting, kind="stable")]
        self.word_first = np.concatenate([[0], np.cumsum(np.bincount(self.posting, minlength=len(parts)))])

    def candidates(self, ids: np.ndarray, half: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item place, largest contained share of a piece): a window is named by its first half.

        Of a window that holds enough of a piece one half holds at least half as much, so only such windows are weighed.
        """
        cols = self.column[ids]
        c, h = cols[cols >= 0].astype(np.int64), half[cols >= 0]
        size, pieces = len(self.weights), len(self.owner)
        key = np.unique(h * size + c)
        if not len(key):
            return
        h, c = key // size, key % size
        held, met = np.bincount(h, self.weights[c]), []
        before = np.append(False, text[1:] == text[:-1])
        h, c = (x[held[h] >= HALF_ENOUGH * self.totals.min()] for x in (h, c))
        for a, b in _cuts(h, max(1, CELLS_AT_ONCE // pieces)):
            each, place = _spread(self.first[c[a:b]], self.first[c[a:b] + 1])
            cell, share = _sums((h[a:b] - h[a])[each] * pieces + self.posting[place], self.weights[c[a:b]][each], HALF_ENOUGH * self.totals.min())
            own = cell[share >= HALF_ENOUGH * self.totals[cell % pieces]]
            own = own + h[a] * pieces
            met += [own, own[before[own // pieces]] - pieces]
        met = np.unique(np.concatenate([np.empty(0, np.int64), *met]))
        window, piece = met // pieces, met % pieces
        each, place = _spread(self.word_first[piece], self.word_first[piece + 1])
        c, at = self.words[place], window[each]
        more = np.append(text[1:] == text[:-1], False)[at]
        has = _among(at * size + c, key) | more & _among((at + 1) * size + c, key)
        share = np.bincount(each, self.weights[c] * has, minlength=len(met)) / self.totals[piece]
        for i in np.flatnonzero(share >= CONTAINED):
            yield int(window[i]), int(self.owner[piece[i]]), float(share[i])


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which place, for every place of several ranges."""
    times = end - first
    each = np.repeat(np.arange(len(first)), times)
    return each, np.arange(len(each)) + np.repeat(first - np.cumsum(times) + times, times)


def _cuts(sorted_rows: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries, each of less than ``most`` rows from its first one on."""
    a = 0
    while a < len(sorted_rows):
        b = int(np.searchsorted(sorted_rows, sorted_rows[a] + most))
        yield a, b
        a = b


def _sums(cells: np.ndarray, value: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells whose values sum up to ``least`` or more: counted in place, or sorted where few of very many cells are met."""
    if len(cells) * 16 >= cells.max(initial=0):
        total = np.bincount(cells, value)
        met = np.flatnonzero(total >= least)
        return met, total[met]
    met, at = np.unique(cells, return_inverse=True)
    return met, np.bincount(at, value, minlength=len(met))


def _among(wanted: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)] == wanted


class Block:
    """At most ``BLOCK`` passages of items: the words that stand for them, their weights, and, once fitted, their axes."""

    def __init__(self, items: Items, members: range, frequency: np.ndarray, passages: int):
        own = [items.passages[k][1] for k in members]
        chosen = telling_words(own, frequency, passages)
        self.members = [items.passages[k][0] for k in members]
        self.column = np.full(len(items.numbers), -1, np.int32)
        self.column[chosen] = np.arange(len(chosen))
        self.weights = word_weights(frequency[chosen], passages)
        words = [self.column[np.array(w)] for w in own]
        self.words = [w[w >= 0] for w in words]
        # A window around a leak holds a third of the item's kept words at least.
        self.need = max(1, min(3, min(len(w) for w in self.words) // 3))

    def fit(self, axes: np.ndarray) -> None:
        self.rank = axes.shape[1]
        self.squares = self.weights**2
        length = np.maximum(np.sqrt([self.squares[w].sum() for w in self.words]), 1e-12)
        latent = self.weights[:, None] * axes
        self.vectors = np.stack([latent[w].sum(0) / n for w, n in zip(self.words, length)]).astype(np.float32)
        self.table = latent.astype(np.float32)
        cols, posting = np.concatenate(self.words), np.repeat(np.arange(len(length)), [len(w) for w in self.words])
        order = np.argsort(cols, kind="stable")
        self.posting, self.first = posting[order], np.searchsorted(cols[order], np.arange(len(axes) + 1))
        self.plain = (self.squares[cols] / length[posting])[order]


def sparse_passages(numbered: DataFrame, items: Items, blocks: list[Block]) -> DataFrame:
    """(words, half): of every chunk of the documents, the numbers of words that stand for items, and their passages."""
    kind = _kind(items)
    kept = np.logical_or.reduce([block.column >= 0 for block in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, parts in _chunks(_read_words(b.column("words"), kind)):
                ids, half, _, _ = _halves(parts)
                near = kept[ids]
                if near.any():
                    own = [ids[near].astype(np.int32).tobytes(), half[near].astype(np.int32).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], names=["words", "half"])

    return numbered.filter("words IS NOT NULL").select("words").transform(map_batches, run, "words binary, half binary")


def _add_pairs(total: np.ndarray, rows: np.ndarray, cols: np.ndarray, value: np.ndarray, low: int, high: int, size: int) -> None:
    """Adds A'A of sparse rows A, on and above the diagonal, to the cells of matrix rows ``low`` to ``high``."""
    ends = np.append(np.flatnonzero(rows[1:] != rows[:-1]) + 1, len(rows))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    a = np.flatnonzero((cols >= low) & (cols < high))
    times = end[a] - a
    each = np.repeat(a, times)
    other = each + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    np.add.at(total, (cols[each] - low) * size + cols[other], value[each] * value[other])


def gram(passages: DataFrame, block: Block) -> DataFrame:
    """(slice, part): the products of all pairs of words summed over all sparse passages, on and above the diagonal.

    The passages are gone through in at most ``SLICES`` tasks, each of which sends a matrix of fixed size in
    slices of rows; a matrix of more than ``CELLS`` numbers is made in several goes.
    """
    column, weights, size = block.column, block.weights, len(block.weights)
    edges = np.linspace(0, size, SLICES + 1).astype(int)

    def part(low: int, high: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((high - low) * size)
            for b in batches:
                for words, half in zip(b.column("words"), b.column("half")):
                    cols = column[np.frombuffer(words.as_py(), np.int32)]
                    own = cols >= 0
                    if own.any():
                        _add_pairs(total, *_tfidf(cols[own], np.frombuffer(half.as_py(), np.int32)[own], weights), low, high, size)
            at = np.flatnonzero(total)
            cuts = np.searchsorted(at + low * size, edges * size)
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
                own = at[cuts[i] : cuts[i + 1]]
                cells = (own + (low - edges[i]) * size).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([cells], pa.binary()), pa.array([total[own].astype(np.float32).tobytes()], pa.binary())],
                    names=["slice", "cells", "sums"],
                )

        return passages.coalesce(SLICES).transform(map_batches, run, "slice int, cells binary, sums binary")

    def add(table: pa.Table) -> pa.Table:
        i = table["slice"][0].as_py()
        total = np.zeros((edges[i + 1] - edges[i]) * size)
        for cells, sums in zip(table["cells"], table["sums"]):
            total[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer(), np.float32)
        return pa.table({"slice": table["slice"][:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    step = max(1, CELLS // size)
    parts = [part(low, min(low + step, size)) for low in range(0, size, step)]
    return reduce(DataFrame.unionByName, parts).groupBy("slice").applyInArrow(add, "slice int, part binary")


def latent_axes(passages: DataFrame, block: Block) -> np.ndarray:
    """(words, rank) right singular directions by randomised subspace iteration over all sparse passages.

    The products of the passages' words are summed once (``gram``). In a round every task multiplies its slices
    of them and sends one matrix of words x (rank + oversample), in single precision and in slices, which are
    summed before they reach the driver.
    """
    weights, size = block.weights, len(block.weights)
    rank = min(RANK, max(1, len(block.words) // 2), size)
    width = min(rank + OVERSAMPLE, size)
    edges = np.linspace(0, size, SLICES + 1).astype(int)
    products = saved(gram(passages, block), "lsa-gram")

    def multiply(exact: np.ndarray) -> np.ndarray:
        matrix = exact.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(exact)
            for b in batches:
                for at, part in zip(b.column("slice"), b.column("part")):
                    i, j = edges[at.as_py()], edges[at.as_py() + 1]
                    upper = np.frombuffer(part.as_buffer(), np.float32).reshape(j - i, size)
                    total[i:j] += upper @ matrix
                    total += upper.T @ matrix[i:j]
                    total[i:j] -= upper[np.arange(j - i), np.arange(i, j)][:, None] * matrix[i:j]
            parts = [total[i:j].astype(np.float32).tobytes() for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names=["slice", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x.as_py(), np.float32) for x in table["part"]], axis=0, dtype=np.float64)
            return pa.table({"slice": table["slice"][:1], "part": pa.array([total.tobytes()], pa.binary())})

        own = np.concatenate(block.words)
        rows = np.repeat(np.arange(len(block.words)), [len(w) for w in block.words])
        total = _product(*_tfidf(own, rows, weights), exact)
        for r in products.transform(map_batches, run, "slice int, part binary").groupBy("slice").applyInArrow(add, "slice int, part binary").collect():
            i, j = edges[r["slice"]], edges[r["slice"] + 1]
            total[i:j] += np.frombuffer(r["part"], np.float64).reshape(j - i, width)
        return total

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0]
    for _ in range(POWER_ROUNDS):
        q = np.linalg.qr(multiply(q))[0]
    inner = q.T @ multiply(q)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return q @ turn[:, np.argsort(-values)[:rank]]


def lcs(item: list[int], words: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine-word row of bits per item word."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        met = row & masks.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


class Searcher:
    """Finds the items of one pass in texts."""

    def __init__(self, items: Items, blocks: list[Block], pieces: Pieces):
        self.items, self.blocks, self.pieces = items, blocks, pieces
        self.reader = TokenReader(items.numbers)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "reader"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reader = TokenReader(self.items.numbers)

    def search(self, words: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item place, cosine, LCS share, answer share) of every leak into texts whose words are given by number.

        The best check of each row and item counts. The cosine is 0 where only the contained share made it a candidate.
        """
        for rows, parts in _chunks(_read_words(words, _kind(self.items))):
            ids, half, first, n = _halves(parts)
            text = np.repeat(np.arange(len(parts)), np.diff(np.append(first, n)))
            near: dict[tuple[int, int], float] = {}
            for block in self.blocks:
                for window, k, cosine in self._candidates(block, ids, half, text):
                    near[window, k] = max(cosine, near.get((window, k), 0.0))
            for window, k, _ in self.pieces.candidates(ids, half, text):
                near.setdefault((window, k), 0.0)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for (window, k), cosine in near.items():
                t = text[window]
                found = self._check(parts[t], (window - first[t]) * HALF_WINDOW, k)
                if found and (*found, cosine) > best.get((t, k), (0, 0, 0)):
                    best[t, k] = (*found, cosine)
            for (t, k), (share, answer, cosine) in sorted(best.items()):
                yield rows[t], k, cosine, share, answer

    @staticmethod
    def _candidates(block: Block, ids: np.ndarray, half: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item place, cosine): a window is named by its first half."""
        cols = block.column[ids]
        kept = np.flatnonzero(cols >= 0)
        c, h, n = cols[kept], half[kept], len(text)
        each = np.bincount(h, minlength=n + 1)
        more = np.append(text[1:] == text[:-1], False)
        windows = np.flatnonzero(each[:n] + each[1:] * more >= block.need)
        for i in range(0, len(windows), WINDOWS_AT_ONCE):
            part = windows[i : i + WINDOWS_AT_ONCE]
            wanted = np.zeros(n + 1, bool)
            wanted[part] = True
            wanted[part[more[part]] + 1] = True
            a, b = np.searchsorted(h, [part[0], part[-1] + 2])
            near = wanted[h[a:b]]
            own_c, own_h = c[a:b][near], h[a:b][near]
            cut = np.concatenate([[0], 1 + np.flatnonzero(own_h[1:] != own_h[:-1])])
            halves = own_h[cut]
            sums = np.add.reduceat(block.table.take(own_c, axis=0), cut, axis=0)
            squares = np.add.reduceat(block.squares[own_c], cut)
            each, place = _spread(block.first[own_c], block.first[own_c + 1])
            row, members = np.repeat(np.arange(len(halves)), np.diff(np.append(cut, len(own_h)))), len(block.members)
            plain = np.bincount(row[each] * members + block.posting[place], block.plain[place], minlength=len(halves) * members)
            plain = plain.astype(np.float32).reshape(-1, members)

            def at(place: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
                k = np.minimum(np.searchsorted(halves, place), len(halves) - 1)
                there = there & (halves[k] == place)
                return sums[k] * there[:, None], squares[k] * there, plain[k] * there[:, None]

            (x, s, p), (y, r, q) = at(part, np.ones(len(part), bool)), at(part + 1, more[part])
            cosine = np.maximum((x + y) @ block.vectors.T, p + q) / np.sqrt(np.maximum(s + r, 1e-12))[:, None]
            for w, k in zip(*np.nonzero(cosine >= CANDIDATE)):
                yield int(part[w]), block.members[k], float(cosine[w, k])

    def _check(self, words: np.ndarray, start: int, k: int) -> tuple[float, float] | None:
        item, answer = self.items.words[k], self.items.answers[k]
        around = words[max(0, start - len(item)) : start + 2 * HALF_WINDOW + len(item)]
        share = lcs(item, around) / len(item)
        if share < LCS_WITH_ANSWER:
            return None
        told = lcs(answer, around) / len(answer) if answer else 0.0
        return (share, told) if share >= LCS or told >= ANSWER else None


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """A searcher for each pass, its statistics counted over all of ``docs`` (doc_id and text)."""
    for searcher, _ in _passes(docs.select("doc_id", text_or_empty().alias("text")), benchmark):
        yield searcher


def _passes(rows: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Searcher, DataFrame]]:
    """For each pass a searcher, and ``rows`` with numbered words (column words) in place of text."""
    named = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    passes = max(1, -(-named.count() // ITEMS_A_PASS))
    for n in range(passes):
        part = named if passes == 1 else named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        items = Items(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1])))
        if not items.words:
            continue
        numbered = numbered_words(rows, items)
        frequency, passages = passage_frequencies(numbered, items)
        blocks = [Block(items, range(i, min(i + BLOCK, len(items.passages))), frequency, passages) for i in range(0, len(items.passages), BLOCK)]
        sparse = saved(sparse_passages(numbered, items, blocks), "lsa-passages")
        for block in blocks:
            block.fit(latent_axes(sparse, block))
        yield Searcher(items, blocks, Pieces(items, frequency, passages)), numbered.filter("words IS NOT NULL").drop("tally")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and answer_share of every leak of an item into a row of ``docs``."""
    spark = docs.sparkSession
    ship_code(spark)
    out = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
        + [T.StructField(n, T.DoubleType()) for n in ("cosine", "lcs_share", "answer_share")]
    )
    item_type = pa.int64() if out["item_id"].dataType == T.LongType() else None
    found = spark.createDataFrame([], out)
    for searcher, numbered in _passes(docs.select("doc_id", text_or_empty().alias("text")), benchmark):
        shared = spark.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for b in batches:
                hits = list(s.search(b.column("words")))
                if hits:
                    rows, items, *figures = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(rows)), pa.array([s.items.ids[k] for k in items], item_type), *[pa.array(f, pa.float64()) for f in figures]],
                        names=out.names,
                    )

        found = found.unionByName(numbered.transform(map_batches, run, out))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with all their columns.

    Rows travel with their numbered words, and every pass marks those it finds: its statistics cover all rows.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"), F.lit(False).alias("_leak"))
    for searcher, numbered in _passes(rows.withColumn("text", text_or_empty("_row.text")), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leak = b.column("_leak").to_numpy(zero_copy_only=False).copy()
                leak[[h[0] for h in shared.value.search(b.column("words"))]] = True
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(leak)], names=["_row", "_leak"])

        rows = numbered.transform(map_batches, run, rows.schema)
    return rows.filter("NOT _leak").select("_row.*")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
