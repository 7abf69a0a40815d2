"""Language-model scoring from a log-frequency Bloom filter.

1. Texts are cut into words once. About ``FLUSH_KEYS`` tokens become one row, a stack: the distinct words,
   the tokens as numbers of these, and the texts' ids.
2. Every stack asks for its distinct words and its distinct pairs of neighbouring words, pairs as 64-bit
   keys, dealt out in buckets by the key; the number of buckets follows the corpus. A bucket sums the exact
   counts in the training rows of its words and pairs.
3. A key with count c enters a Bloom filter at the levels 1 .. 1 + floor(log_b(c / floor)), the log
   frequency. Every bucket owns a segment of the filter, builds it alone and probes it for all that was
   asked: level after level until one is missing, which gives the quantised count, never above it but for
   the filter's false positives. Keys seen once enter too. A segment's size follows its counted levels, so
   that at most half of it is filled. Only a caller that names a size gets a filter of that size, whose
   floors rise until it fits.
4. The answers go back to the stacks by a shuffle, so no filter, vocabulary or segment reaches the driver
   or is broadcast: exact counts of words, for the base score, and levels of words and pairs. The model
   knows the ``HEAD`` most frequent words exactly and the rest by their levels.
5. A word's probability mixes its relative frequency after the word before with its smoothed unigram
   probability. The weight, by how often the word before was seen, is estimated by leaving one out over
   all training rows. Scoring sums every document's logarithms for each weight in question, so that
   the tuning needs no pass of its own.

``train`` gathers the whole filter for a caller that wants it as one object; scoring does without.

Nulls: a null text is the empty text: one end token. A null id falls into the fold of the empty id.
Repeated rows are scored each. An empty table gives an empty result; without training rows all counts
are zero, and the base score of a token is log10(1/1).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import in_fold, map_batches, saved, ship_code, text_or_empty

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 17
LEAST_FILTER_BYTES = 1 << 16
HASHES = 4
BASE = 1.5
LEVELS = 64
FLOOR = 1
BUCKET_TOKENS = 1 << 20
LEAST_BUCKETS = 64
#: Bits of a key beyond its bucket's: two of a bucket's million keys meet about once in two buckets.
KEY_BITS = 40
MEMORY = 150_000
CHUNK_TOKENS = 1 << 17
FLUSH_KEYS = 1 << 21
FLUSH_ROWS = 1 << 16
GRID = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])
BINS = 8
#: Spark's xxhash64 of a string with its default seed, so that both sides agree.
SEED = 42
END = b""


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def _word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes + np.uint64(1))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(before + np.uint64(2)) + word)


def _trim(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys by their bucket and ``KEY_BITS`` more."""
    spare = max(0, 64 - bits - KEY_BITS)
    return keys >> np.uint64(spare) << np.uint64(spare)


class Words:
    """Hashes and exact head counts of words, remembered for a bounded number of them."""

    def __init__(self, head: dict[bytes, int]):
        self.head, self.place = head, {}
        self.hashes, self.counts = np.zeros(MEMORY + CHUNK_TOKENS, np.uint64), np.zeros(MEMORY + CHUNK_TOKENS, np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in ``hashes`` and ``counts`` (-1: not in the head), good until the next call."""
        if len(self.place) > MEMORY:
            self.place = {}
        place = self.place
        out = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            known = len(place)
            late = [words[i] for i in missing.tolist()]
            new = dict(zip(dict.fromkeys(late), count(known)))
            place.update(new)
            self.hashes[known : known + len(new)] = _word_hashes(new, len(new))
            self.counts[known : known + len(new)] = np.fromiter(map(self.head.get, new, repeat(-1)), np.int64, len(new))
            out[missing] = np.fromiter(map(new.__getitem__, late), np.int64, len(late))
        return out


def _chunks(texts: pa.Array) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows and their tokens, about ``CHUNK_TOKENS`` a time; a longer text is a chunk alone."""
    rows, tokens, n = [], [], 0
    for i, t in enumerate(texts):
        words = words_of(t.as_py())
        if rows and n + len(words) + 1 > CHUNK_TOKENS:
            yield rows, tokens
            rows, tokens, n = [], [], 0
        words.append(END)
        rows.append(i)
        tokens.append(words)
        n += len(words)
    if rows:
        yield rows, tokens


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n): exact counts of all training tokens, the end token as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                counts.update(words_of(t.as_py()))
                counts[END] += 1
                if len(counts) > MEMORY:
                    yield from flush(counts)
        yield from flush(counts)

    def flush(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(counts.keys()), list(counts.values())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], names=["word", "n"])
        counts.clear()

    return training.select("text").transform(map_batches, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


BLOBS = "bucket int, keys binary, counts binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys with counts, cut into one row per bucket (the keys' first bits)."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
    packed = (keys << np.uint64(bits) >> np.uint64(64 - KEY_BITS)).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    cuts = np.concatenate([[0], 1 + np.flatnonzero(bucket[1:] != bucket[:-1]), [len(keys)]])
    spans = list(zip(cuts[:-1], cuts[1:]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts[:-1]]),
            pa.array([packed[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([np.minimum(counts[a:b], 2**32 - 1).astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
        ],
        names=["bucket", "keys", "counts"],
    )


def _cut(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted keys, at least one, and the sums of their counts."""
    first = np.concatenate([[0], 1 + np.flatnonzero(keys[1:] != keys[:-1])])
    return keys[first], np.add.reduceat(counts, first)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    return _cut(keys[order], counts[order])


def key_counts(training: DataFrame, vocabulary: DataFrame, bits: int) -> DataFrame:
    """(bucket, keys, counts): exact counts of all pairs and words, a bucket a row; counts beyond 32 bits stay at the top."""

    def word_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _word_hashes(b.column("word").to_pylist(), b.num_rows)
            yield from _blobs(*_summed(_trim(unigram_keys(h), bits), b.column("n").to_numpy()), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words({})
        held: list[np.ndarray] = []
        for b in batches:
            for _, tokens in _chunks(b.column("text")):
                h = [words.hashes[words.look_up(part)] for part in _parts(tokens)]
                h = np.concatenate([[np.uint64(_word_hash(END))], *h])
                held.append(_trim(pair_keys(h[:-1], h[1:]), bits))
                if sum(map(len, held)) >= FLUSH_KEYS:
                    yield from _blobs(*np.unique(np.concatenate(held), return_counts=True), bits)
                    held = []
        if held:
            yield from _blobs(*np.unique(np.concatenate(held), return_counts=True), bits)

    def merge(table: pa.Table) -> pa.Table:
        words = _read_blobs(table.filter(table["words"]), bits)
        pairs = _summed(*_read_blobs(table.filter(pc.invert(table["words"])), bits))
        batches = list(_blobs(*(np.concatenate(x) for x in zip(pairs, words)), bits))
        return pa.Table.from_batches(batches) if batches else pa.table({"bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})

    pairs = training.select("text").transform(map_batches, run, BLOBS).withColumn("words", F.lit(False))
    words = vocabulary.select("word", "n").transform(map_batches, word_entries, BLOBS).withColumn("words", F.lit(True))
    return pairs.unionByName(words).groupBy("bucket").applyInArrow(merge, BLOBS)


def _parts(tokens: list[list[bytes]]) -> Iterator[list[bytes]]:
    """The tokens of several texts in a row, in runs that ``Words`` can hold."""
    flat = list(chain.from_iterable(tokens))
    for i in range(0, len(flat), CHUNK_TOKENS):
        yield flat[i : i + CHUNK_TOKENS]


def _read_blobs(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of one bucket's rows."""
    if not len(table):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = KEY_BITS // 8
    packed = np.concatenate([np.frombuffer(k.as_buffer(), np.uint8) for k in table["keys"]]).reshape(-1, width)
    counts = np.concatenate([np.frombuffer(c.as_buffer(), np.uint32) for c in table["counts"]]).astype(np.int64)
    rest = np.zeros((len(packed), 8), np.uint8)
    rest[:, :width] = packed
    bucket = np.uint64(table["bucket"][0].as_py())
    return bucket << np.uint64(64 - bits) | rest.view(np.uint64)[:, 0] << np.uint64(64 - KEY_BITS) >> np.uint64(bits), counts


def levels_of(counts: np.ndarray, floor: int) -> np.ndarray:
    """1 + floor(log_b(c / floor)), and 0 below the floor."""
    with np.errstate(divide="ignore"):
        level = 1 + np.floor(np.log(np.maximum(counts, 1) / floor) / np.log(BASE) + 1e-9).astype(np.int64)
    return np.where(counts >= floor, np.clip(level, 1, LEVELS), 0)


class CountFilter:
    """The filter: ``bits`` leading key bits choose the segment, hashes of key and level its places.

    With ``bucket`` it holds that bucket's segment alone, for the bucket's keys.
    """

    def __init__(self, data: np.ndarray, bits: int, floor: int, bucket: int | None = None):
        self.data, self.bits, self.floor, self.bucket = data, bits, floor, bucket
        self.segment = len(data) * 8 >> (bits if bucket is None else 0)

    @staticmethod
    def places(keys: np.ndarray, level: int | np.ndarray, n: int, segment: int) -> np.ndarray:
        step = np.atleast_1d(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([n + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return _mix(keys + step) & np.uint64(segment - 1)

    def estimate(self, keys: np.ndarray, entered: np.ndarray | None = None) -> np.ndarray:
        """Quantised counts: probes level after level until one is missing; equal keys are probed once.

        Keys known to have ``entered``, once at least, are found on the first level and not probed there if its floor is one.
        """
        every, whose = np.unique(_trim(keys, self.bits), return_inverse=True)
        level = np.zeros(len(every), np.int64)
        if entered is not None and self.floor <= 1:
            level[whose[entered]] = 1
        return quantised(self.levels(every, level), self.floor)[whose]

    def levels(self, every: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The levels of trimmed keys, from those that are known already (1, else 0)."""
        level = level.copy()
        for j in range(1, LEVELS + 1):
            alive = np.flatnonzero(level == j - 1)
            keys = every[alive]
            origin = (keys >> np.uint64(64 - self.bits)) * np.uint64(self.segment) if self.bucket is None else np.zeros(len(keys), np.uint64)
            for n in range(HASHES):
                at = origin + self.places(keys, j, n, self.segment)
                met = np.flatnonzero((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                alive, keys, origin = alive[met], keys[met], origin[met]
            level[alive] = j
            if level.max(initial=0) < j:
                break
        return level


def quantised(level: np.ndarray, floor: int | np.ndarray) -> np.ndarray:
    """The least count of a level; 0 below the first."""
    return np.where(level > 0, floor * BASE ** (level - 1.0), 0.0)


def _filled(keys: np.ndarray, counts: np.ndarray, floor: int, segment: int) -> np.ndarray:
    """The bytes of one segment of ``segment`` bits."""
    flags = np.zeros(segment, bool)
    level = levels_of(counts, floor)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= j]
        for n in range(HASHES):
            flags[CountFilter.places(own, j, n, segment)] = True
    return np.packbits(flags, bitorder="little")


def _floor(spectrum: dict[int, int], size: int, least: int) -> int:
    """The least floor from ``least`` on at which the counted levels fill half of ``size`` bits at most."""
    lowest = 1
    while 2 * HASHES * sum(n * (level - lowest + 1) for level, n in spectrum.items() if level >= lowest) > size:
        lowest += 1
    return int(np.ceil(least * BASE ** (lowest - 1) - 1e-9))


def bucket_filter(keys: np.ndarray, counts: np.ndarray, bits: int, bucket: int, size: int | None = None, least: int = FLOOR) -> CountFilter:
    """One bucket's segment, as wide as its counted levels ask for, or its share of a filter of ``size`` bytes."""
    spectrum = dict(zip(*(x.tolist() for x in np.unique(levels_of(counts, least), return_counts=True))))
    if size is None:
        wanted = 2 * HASHES * sum(n * level for level, n in spectrum.items())
        segment = 1 << (max(LEAST_FILTER_BYTES * 8 >> bits, 8, wanted) - 1).bit_length()
    else:
        segment = size * 8 >> bits
    floor = _floor(spectrum, segment, least)
    return CountFilter(_filled(keys, counts, floor, segment), bits, floor, bucket)


def build_filter(entries: DataFrame, bits: int, size: int | None = None, least: int = 2) -> CountFilter:
    """From (bucket, keys, counts), a bucket a row: each sets the bits of its own segment, and all reach the driver.

    Counts from ``least`` on enter. Without a ``size`` the filter has room for all of them.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("counts"):
                n, k = np.unique(levels_of(np.frombuffer(c.as_py(), np.uint32), least), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(k.astype(np.int64))], names=["level", "keys"])

    spectrum = {r["level"]: r["n"] for r in entries.select("counts").transform(map_batches, tally, "level int, keys bigint").groupBy("level").agg(F.sum("keys").alias("n")).collect()}
    if size is None:
        wanted = HASHES * sum(n * level for level, n in spectrum.items()) // 4
        size = 1 << (max(LEAST_FILTER_BYTES, 1 << bits, wanted) - 1).bit_length()
    floor = _floor(spectrum, 8 * size, least)
    segment = size * 8 >> bits

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1) for i in range(b.num_rows)):
                keys, counts = _read_blobs(row, bits)
                yield pa.RecordBatch.from_arrays([row["bucket"], pa.array([_filled(keys, counts, floor, segment).tobytes()], pa.binary())], names=["bucket", "bits"])

    data = np.zeros(size, np.uint8)
    width = size >> bits
    for r in entries.select("bucket", "keys", "counts").transform(map_batches, fill, "bucket int, bits binary").collect():
        data[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return CountFilter(data, bits, floor)


class Model:
    """The whole filter, head counts and totals."""

    def __init__(self, counts: CountFilter, head: dict[bytes, int], tokens: int, distinct: int):
        self.counts, self.head, self.tokens, self.distinct = counts, head, tokens, distinct


def mixed(pairs: np.ndarray, seen_before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative frequency after the word before, the bin of its weight, and whether there is one."""
    follow = np.where(seen_before > 0, pairs / np.maximum(seen_before, 1), 0.0)
    slot = np.clip(np.log2(np.maximum(seen_before, 1)) / 2, 0, BINS - 1).astype(int)
    return follow, slot, seen_before > 0


def by_weight(unigram: np.ndarray, follow: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """(groups, weights): log10 probabilities summed by group, for every weight of the grid.

    A word that never follows the word before has the weighted unigram probability alone: one logarithm serves all weights.
    """
    follows = follow > 0
    alone = group[~follows]
    times, sums = np.bincount(alone, minlength=groups), np.bincount(alone, np.log(unigram[~follows]), minlength=groups)
    unigram, follow, group = unigram[follows], follow[follows], group[follows]
    out = np.empty((groups, len(GRID)))
    for g, w in enumerate(GRID):
        out[:, g] = sums + times * np.log(1 - w) + np.bincount(group, np.log(w * follow + (1 - w) * unigram), minlength=groups)
    return out / np.log(10)  # numpy takes natural logarithms several at a time


def train(training: DataFrame, size: int | None = None) -> tuple[Model, DataFrame]:
    """The model, gathered by the driver, and the exact vocabulary (word, n)."""
    vocabulary = saved(word_counts(training), "lm-vocabulary")
    tokens, distinct = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens = tokens or 0
    top = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    head = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    head.setdefault(END, 0)
    bits = (max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS)) - 1).bit_length()
    counts = build_filter(saved(key_counts(training, vocabulary, bits), "lm-keys"), bits, size, FLOOR)
    return Model(counts, head, tokens, distinct), vocabulary


def best_weights(scored: DataFrame) -> np.ndarray:
    """For every bin the place in ``GRID`` of the weight with the largest sum of ``tuning`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS * len(GRID))
        for b in batches:
            total += b.column("tuning").flatten().to_numpy().reshape(-1, BINS * len(GRID)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "s"])

    sums = np.zeros(BINS * len(GRID))
    for r in scored.filter("tuning IS NOT NULL").select("tuning").transform(map_batches, run, "place bigint, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():
        sums[r["place"]] = r["s"]
    return sums.reshape(BINS, len(GRID)).argmax(1)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _array(parts: Iterable[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(bytearray().join(parts), kind)


ASKS = "stack bigint, bucket int, keys binary, counts binary, words binary, word_counts binary"
ANSWERS = "stack bigint, bucket int, levels binary, totals binary, word_levels binary, floor bigint, words binary"


def stacks(rows: DataFrame) -> DataFrame:
    """(stack, tokens, trained, words, ids, counts, lengths, held_out, doc_id): many texts a row, cut into words.

    ``words`` are the distinct ones, the frequent first, with a blank between; ``ids`` their numbers for every token, the four
    bytes of a number apart; ``counts`` how often they occur in training rows, ``trained`` the tokens there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, held = defaultdict(count().__next__), [], []
        n = 0
        for b in batches:
            kept, start = b.select(["row_no", "held_out", "doc_id"]), 0
            for i, t in enumerate(b.column("text").cast(pa.large_binary())):
                words = t.as_py().lower().split()
                words.append(END)
                if ids and (n + len(words) > FLUSH_KEYS or len(ids) == FLUSH_ROWS):
                    yield stack(place, ids, [*held, kept.slice(start, i - start)])
                    place, ids, held, start, n = defaultdict(count().__next__), [], [], i, 0
                ids.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                n += len(words)
            held.append(kept.slice(start))
        if ids:
            yield stack(place, ids, held)

    def stack(place: dict[bytes, int], ids: list[np.ndarray], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = pa.Table.from_batches(held).combine_chunks()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        ids = np.concatenate(ids)
        words = list(place)
        order = np.argsort(-np.bincount(ids), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        ids = rank[ids]
        own = np.repeat(~texts["held_out"].to_numpy(), lengths)
        return pa.RecordBatch.from_arrays(
            [
                texts["row_no"].chunk(0)[:1],
                pa.array([len(ids)], pa.int64()),
                pa.array([int(own.sum())], pa.int64()),
                pa.array([_pack(b" ".join([words[i] for i in order.tolist()]))], pa.binary()),
                pa.array([_pack(ids.view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
                pa.array([_pack(np.bincount(ids[own], minlength=len(words)).astype(np.uint32).tobytes())], pa.binary()),
                pa.array([lengths.tolist()], pa.list_(pa.int64())),
                *(pa.ListArray.from_arrays([0, len(texts)], texts[c].chunk(0)) for c in ("held_out", "doc_id")),
            ],
            names=["stack", "tokens", "trained", "words", "ids", "counts", "lengths", "held_out", "doc_id"],
        )

    out = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("stack", "tokens", "trained")]
        + [T.StructField(n, T.BinaryType()) for n in ("words", "ids", "counts")]
        + [T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("held_out", T.ArrayType(T.BooleanType()))]
        + [T.StructField("doc_id", T.ArrayType(rows.schema["doc_id"].dataType))]
    )
    return rows.withColumn("row_no", F.monotonically_increasing_id()).transform(map_batches, run, out)


class Stack:
    """One row of ``stacks``, unpacked, with the keys of its words and of every token and the token before."""

    def __init__(self, row: pa.Table | pa.RecordBatch, bits: int):
        self.words = _unpack(row["words"][0].as_py()).split(b" ")
        self.ids = _array([_unpack(row["ids"][0].as_py())], np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]
        self.lengths = row["lengths"][0].values.to_numpy()
        self.held_out, end = row["held_out"][0].values, np.uint64(_word_hash(END))
        self.own = np.repeat(~self.held_out.to_numpy(zero_copy_only=False), self.lengths)
        hashes = _word_hashes(self.words, len(self.words))
        self.word_keys = _trim(unigram_keys(hashes), bits)
        #: The words by their buckets.
        self.order = np.argsort(self.word_keys >> np.uint64(64 - bits), kind="stable")
        h = np.concatenate([[end], hashes[self.ids]])
        self.pair_keys = _trim(pair_keys(h[:-1], h[1:]), bits)


def asks(stacked: DataFrame, bits: int) -> DataFrame:
    """(stack, bucket, keys, counts, words, word_counts): a stack's distinct pairs and words in each bucket, with their counts in its training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1) for i in range(b.num_rows)):
                yield ask(row)

    def ask(row: pa.RecordBatch) -> pa.RecordBatch:
        s = Stack(row, bits)
        # The last bit of a trimmed key is free.
        keys, n = np.unique(s.pair_keys | s.own, return_counts=True)
        n *= (keys & np.uint64(1)).astype(np.int64)
        keys, counts = _cut(keys >> np.uint64(1) << np.uint64(1), n)
        words = [s.words[i] for i in s.order.tolist()]
        word_counts = _array([_unpack(row["counts"][0].as_py())], np.uint32)[s.order]
        packed = (keys << np.uint64(bits) >> np.uint64(64 - KEY_BITS)).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        buckets = np.arange((1 << bits) + 1, dtype=np.uint64)
        pairs_at = np.searchsorted(keys >> np.uint64(64 - bits), buckets)
        words_at = np.searchsorted((s.word_keys >> np.uint64(64 - bits))[s.order], buckets)
        some = np.flatnonzero(np.diff(pairs_at) + np.diff(words_at))
        pairs = list(zip(pairs_at[some].tolist(), pairs_at[some + 1].tolist()))
        spans = list(zip(words_at[some].tolist(), words_at[some + 1].tolist()))
        counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                row["stack"].take(pa.array(np.zeros(len(some), np.int64))),
                pa.array(some.astype(np.int32)),
                pa.array([packed[x:y].tobytes() for x, y in pairs], pa.binary()),
                pa.array([counts[x:y].tobytes() for x, y in pairs], pa.binary()),
                pa.array([b" ".join(words[x:y]) for x, y in spans], pa.binary()),
                pa.array([word_counts[x:y].tobytes() for x, y in spans], pa.binary()),
            ],
            names=["stack", "bucket", "keys", "counts", "words", "word_counts"],
        )

    return stacked.select("stack", "words", "ids", "counts", "lengths", "held_out").transform(map_batches, run, ASKS)


def answers(asked: DataFrame, bits: int, size: int | None = None) -> DataFrame:
    """(stack, bucket, levels, totals, word_levels, floor): to every ask the levels of its pairs, and exact counts and levels of its words.

    A row without a stack has a bucket's ``words`` in the training rows and their ``totals``.
    """

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, counts = _read_blobs(table, bits)
        cuts = np.cumsum([0, *(len(k.as_buffer()) // (KEY_BITS // 8) for k in table["keys"])]).tolist()
        keys, whose = np.unique(keys, return_inverse=True)
        counts = np.bincount(whose, counts, len(keys)).astype(np.int64)
        place, word_cuts, word_ids = defaultdict(count().__next__), [0], []
        for words, n in zip(table["words"], table["word_counts"]):
            n = len(n.as_buffer()) // 4
            if n:
                word_ids.append(np.fromiter(map(place.__getitem__, words.as_py().split(b" ")), np.int64, n))
            word_cuts.append(word_cuts[-1] + n)
        word_ids = np.concatenate([np.empty(0, np.int64), *word_ids])
        totals = np.bincount(word_ids, _array((n.as_buffer() for n in table["word_counts"]), np.uint32), len(place)).astype(np.int64)
        words = list(place)
        word_keys = _trim(unigram_keys(_word_hashes(words, len(words))), bits)
        every, n = np.concatenate([keys, word_keys]), np.concatenate([counts, totals])
        own = bucket_filter(every, n, bits, bucket, size)
        level = own.levels(every, ((n > 0) & (own.floor <= 1)).astype(np.int64)).astype(np.uint8)
        levels, word_levels = level[: len(keys)][whose], level[len(keys) :][word_ids]
        seen, told = np.flatnonzero(totals), totals[word_ids]
        spans, word_spans = list(zip(cuts[:-1], cuts[1:])), list(zip(word_cuts[:-1], word_cuts[1:]))
        return pa.table(
            [
                pa.array([*table["stack"].to_pylist(), None], pa.int64()),
                pa.array([bucket] * (len(spans) + 1), pa.int32()),
                pa.array([*(levels[a:b].tobytes() for a, b in spans), None], pa.binary()),
                pa.array([*(told[a:b].tobytes() for a, b in word_spans), totals[seen].tobytes()], pa.binary()),
                pa.array([*(word_levels[a:b].tobytes() for a, b in word_spans), None], pa.binary()),
                pa.array([own.floor] * (len(spans) + 1), pa.int64()),
                pa.array([*[None] * len(spans), b" ".join([words[i] for i in seen.tolist()])], pa.binary()),
            ],
            names=["stack", "bucket", "levels", "totals", "word_levels", "floor", "words"],
        )

    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


def vocabulary_of(answered: DataFrame) -> DataFrame:
    """(word, n): exact counts of all training tokens, the end token as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, totals in zip(b.column("words"), b.column("totals")):
                n = _array([totals.as_buffer()], np.int64)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(words.as_py().split(b" "), pa.binary()), pa.array(n)], names=["word", "n"])

    return answered.filter("stack IS NULL").select("words", "totals").transform(map_batches, run, "word binary, n bigint")


def score_documents(docs: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    ship_code(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"), in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"))
    stacked = saved(stacks(rows), "lm-stacks")
    tokens, train_tokens = (n or 0 for n in stacked.agg(F.sum("tokens"), F.sum("trained")).first())
    # Held-out texts ask too, so buckets follow all tokens; BUCKET_TOKENS are of training rows, as a rule all folds but one.
    bits = (max(LEAST_BUCKETS, -(-tokens * (FOLDS - 1) // (FOLDS * BUCKET_TOKENS))) - 1).bit_length()
    answered = saved(answers(asks(stacked, bits), bits, size), "lm-answers")
    vocabulary = vocabulary_of(answered)
    distinct = vocabulary.count()
    space = float(train_tokens + distinct + 1)
    last = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).orderBy("n", F.desc("word")).first()
    last_count, last_word = (last["n"], bytes(last["word"])) if last else (0, END)

    def head(words: list[bytes], totals: np.ndarray) -> np.ndarray:
        """Which of the words are among the most frequent; the end token counts as such."""
        out = totals > last_count
        for i in np.flatnonzero((totals == last_count) & (totals > 0)).tolist():
            out[i] = words[i] <= last_word
        out[words.index(END)] = True
        return out

    def score(row: pa.Table, told: pa.Table) -> pa.Table:
        s = Stack(row, bits)
        told = told.sort_by("bucket")
        floors = np.ones(1 << bits)
        floors[told["bucket"].to_numpy()] = told["floor"].to_numpy()
        told = {c: _array((x.as_buffer() for x in told[c]), k) for c, k in (("levels", np.uint8), ("totals", np.int64), ("word_levels", np.uint8))}
        exact, guess = np.empty(len(s.words), np.int64), np.empty(len(s.words))
        exact[s.order] = told["totals"]
        guess[s.order] = quantised(told["word_levels"], floors[s.word_keys[s.order] >> np.uint64(64 - bits)])
        of_word = np.where(head(s.words, exact), exact, guess)
        keys, whose = np.unique(s.pair_keys, return_inverse=True)
        pairs = quantised(told["levels"], floors[keys >> np.uint64(64 - bits)])[whose]
        known = of_word[s.ids]
        seen = np.concatenate([[of_word[s.words.index(END)]], known[:-1]])
        pairs = np.minimum(pairs, seen)
        unigram = ((of_word + 1) / space)[s.ids]
        base, in_training = np.log10((exact + 1) / space)[s.ids], (exact > 0).astype(np.int64)[s.ids]
        ends = np.cumsum(s.lengths)
        starts = ends - s.lengths
        have: tuple[list, ...] = ([], [], [], [], [])
        for a, z in _runs(ends):
            at, lengths = slice(starts[a], ends[z - 1]), s.lengths[a:z]
            parts = summed(unigram[at], pairs[at], seen[at], s.own[at], lengths)
            for held, x in zip(have, (np.add.reduceat(in_training[at], starts[a:z] - starts[a]), np.add.reduceat(base[at], starts[a:z] - starts[a]), *parts)):
                held.append(x)
        n_known, base_score, unseen, sums, tuning = have
        return pa.table(
            [
                row["doc_id"][0].values,
                s.held_out,
                pa.array(s.lengths),
                *(pa.array(np.concatenate(x)) for x in (n_known, base_score, unseen)),
                _lists(np.concatenate(sums)),
                pa.concat_arrays([x for t, u in zip(tuning, unseen) for x in (_lists(t), pa.nulls(len(u) - 1, _lists(t).type))]),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "unseen", "sums", "tuning"],
        )

    out = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "unseen")]
        + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("sums", "tuning")]
    )
    told = answered.filter("stack IS NOT NULL").drop("words")
    scored = saved(stacked.drop("tokens", "trained", "counts").groupBy("stack").cogroup(told.groupBy("stack")).applyInArrow(score, out), "lm-scored")
    total = F.col("unseen")
    for slot, g in enumerate(best_weights(scored)):
        total = total + F.col("sums")[int(slot * len(GRID) + g)]
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", total.alias("score"))


def summed(unigram: np.ndarray, pairs: np.ndarray, seen: np.ndarray, own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts in a row: logarithms where the word before was never seen, those of the rest by bin and weight, and those for the tuning."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    follow, slot, any_seen = mixed(pairs, seen)
    sums = by_weight(unigram[any_seen], follow[any_seen], (row * BINS + slot)[any_seen], len(lengths) * BINS)
    # Training tokens are left out of their own counts.
    follow, slot, others_seen = mixed(np.maximum(pairs[own] - 1, 0), seen[own] - 1)
    tuning = by_weight(unigram[own][others_seen], follow[others_seen], slot[others_seen], BINS)
    unseen = np.add.reduceat(np.where(any_seen, 0.0, np.log10(unigram)), np.cumsum(lengths) - lengths)
    return unseen, sums.reshape(len(lengths), -1), tuning.reshape(1, -1)


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts that hold about ``CHUNK_TOKENS`` together, from their ends; a longer text is alone."""
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_TOKENS, "right")))
        yield a, z
        a = z


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]), rows.ravel())


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
