"""From documents to skip-gram training examples.

Every random choice is a hash of the seed and the row's own key, so it does not depend on how the
rows are partitioned and a recomputed task makes the same choice again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.functions.md5 import md5_words
from terralex.functions.scalars import hash_uniform
from terralex.operators.scan import block_segment, dense_position, position_across, with_halo
from terralex.session import ship_code

MAX_VOCAB = 20_000
MIN_COUNT = 12
SUBSAMPLE_THRESHOLD = 5e-4
NEGATIVE_POWER = 0.75
SLOTS = 10_000_000
DOC_BLOCK = 65_536


def tokenize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of two or more letters a-z of the lower-cased text: (id, pos, word)."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{2,}"), F.lit(0))
    return docs.select(id_col, F.posexplode(words).alias("pos", "word"))


def vocab(tokens: DataFrame, max_size: int = MAX_VOCAB, min_count: int = MIN_COUNT) -> DataFrame:
    """The most frequent words, earliest first among equals: (word_id, word, count, freq).

    The cap bounds the table, so numbering it in one task and broadcasting it are safe.
    """
    # First by word and document, then by word: plain columns, so both aggregates are hashed.
    per_doc = tokens.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("_c"), F.min("pos").alias("_p"))
    counted = per_doc.groupBy("word").agg(
        F.sum("_c").alias("count"), F.min("doc_id").alias("_doc"), F.min_by("_p", "doc_id").alias("_pos")
    )
    first = [F.desc("count"), F.asc("_doc"), F.asc("_pos")]
    top = counted.filter(F.col("count") >= min_count).orderBy(*first).limit(max_size)
    rank = Window.orderBy(*first)
    everything = Window.partitionBy()
    return top.select(
        (F.row_number().over(rank) - 1).cast("bigint").alias("word_id"), "word", "count",
        (F.col("count") / F.sum("count").over(everything)).alias("freq"),
    )


def vocab_coverage(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """How much of the corpus the vocabulary covers, by tokens and by distinct words."""
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    flagged = counts.join(words.select("word", F.lit(1).alias("_in")), "word", "left")
    inside = F.col("_in").isNotNull()
    kept, total = F.sum(F.when(inside, F.col("n")).otherwise(0)), F.sum("n")
    types, all_types = F.sum(inside.cast("int")), F.count(F.lit(1))
    return flagged.agg(
        kept.alias("kept_tokens"), total.alias("total_tokens"), (F.lit(100.0) * kept / total).alias("token_pct"),
        types.alias("kept_types"), all_types.alias("total_types"), (F.lit(100.0) * types / all_types).alias("type_pct"),
    )


def out_of_vocabulary(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return words.join(vocabulary.select("word"), "word", "left_anti")


def encode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens as word ids, unknown words dropped: (doc_id, pos, word_id, freq).

    The vocabulary's cap bounds it, so all tasks get it, and tokens are not shuffled by word.
    """
    return tokens.join(F.broadcast(vocabulary.select("word", "word_id", "freq")), "word").select("doc_id", "pos", "word_id", "freq")


def drop_probability(freq: Column, threshold: float = SUBSAMPLE_THRESHOLD) -> Column:
    p = 1.0 - F.sqrt(F.lit(threshold) / freq)
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def subsample(encoded: DataFrame, threshold: float = SUBSAMPLE_THRESHOLD, seed: int = 42) -> DataFrame:
    """Drop frequent words at random; a token stays when its draw exceeds the drop probability."""
    draw = hash_uniform(seed, F.col("doc_id"), F.col("pos"))
    return encoded.filter(draw > drop_probability(F.col("freq"), threshold))


def renumber(tokens: DataFrame, scope: str = "document") -> DataFrame:
    """Dense positions ``place`` after tokens were removed, per document or over the whole corpus.

    The corpus order is by document id, then position.
    """
    if scope == "document":
        return dense_position(tokens, ["doc_id"], ["pos"], block_segment(F.col("pos"), DOC_BLOCK), "place")
    if scope != "corpus":
        raise ValueError("scope is 'document' or 'corpus'")
    return position_across(tokens, ["doc_id"], ["pos"], block_segment(F.col("pos"), DOC_BLOCK), "place")


def skipgram_pairs(tokens: DataFrame, window: int, seed: int = 42, scope: str = "document", block: int = 4096) -> DataFrame:
    """Each token with the tokens up to w places away, w drawn from 1..window per token.

    ``tokens`` have dense positions ``place`` of the same scope. Blocks of positions carry copies of
    their edges, so a huge document is spread over many tasks and no pair is lost at a block's end.
    Output: (doc_id, place, shift, center, context).
    """
    keys = ["doc_id"] if scope == "document" else []
    reach = F.floor(hash_uniform(seed, F.lit("w"), F.col("doc_id"), F.col("pos")) * window) + 1
    placed = with_halo(tokens.withColumn("_w", reach), "place", max(block, window), window, window)
    order = Window.partitionBy(*keys, "_block").orderBy("place")
    offsets = [s for s in range(-window, window + 1) if s]
    # Rows at fixed offsets, not a list of the whole frame: nothing is gathered and no item function is interpreted.
    near = {f"_{c}{i}": F.lead(c, s).over(order) for i, s in enumerate(offsets) for c in ("place", "word_id")}
    seen = placed.select("*", *[v.alias(n) for n, v in near.items()]).filter("_core")
    shift = lambda i: F.col(f"_place{i}") - F.col("place")
    close = [
        F.when((shift(i) != 0) & (F.abs(shift(i)) <= F.col("_w")), F.struct(shift(i).alias("shift"), F.col(f"_word_id{i}").alias("context")))
        for i in range(len(offsets))
    ]
    out = seen.select("doc_id", "pos", "place", F.col("word_id").alias("center"), F.explode(F.array(*close)).alias("_c")).filter("_c IS NOT NULL")
    return out.select("doc_id", "pos", "place", "_c.shift", "center", "_c.context")


def negative_slots(vocabulary: DataFrame, slots: int = SLOTS, power: float = NEGATIVE_POWER) -> DataFrame:
    """Each word's interval of the sampling table, [slot_start, slot_end); words with none are left out.

    Filling slot by slot moves on by at most one word per slot, so a word's end is
    ``id + max over earlier words of floor(slots * cumulative share) + 1 - id``. The vocabulary's
    cap bounds these windows.
    """
    by_id = Window.orderBy("word_id")
    upto = by_id.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    share = F.pow(F.col("count").cast("double"), F.lit(power))
    shared = vocabulary.select("word_id", "word", (share / F.sum(share).over(whole)).alias("_s"), F.max("word_id").over(whole).alias("_last"))
    # Summing at 15 places keeps the running sum independent of the order of additions.
    exact = F.sum(F.col("_s").cast("decimal(24,15)")).over(upto).cast("double")
    lead = F.max(F.floor(F.lit(float(slots)) * F.col("_c")) + 1 - F.col("word_id")).over(upto)
    ends = shared.withColumn("_c", exact).withColumn("_e", F.least(F.col("word_id") + lead, F.lit(slots)))
    ends = ends.withColumn("_e", F.when(F.col("word_id") == F.col("_last"), F.lit(slots)).otherwise(F.col("_e")).cast("bigint"))
    start = F.coalesce(F.lag("_e").over(by_id), F.lit(0)).cast("bigint")
    return ends.withColumn("slot_start", start).filter(F.col("_e") > F.col("slot_start")).select(
        "word_id", "word", "slot_start", F.col("_e").alias("slot_end")
    )


#: Slots at most for which a task looks words up slot by slot.
DIRECT_SLOTS = 1 << 24


class _SlotWords:
    """The words' intervals, found slot by slot, or of many slots through a coarse cell. The vocabulary's cap bounds the table."""

    def __init__(self, table: DataFrame, slots: int, cells: int):
        rows = sorted(tuple(r) for r in table.select("slot_start", "slot_end", "word_id").collect())
        self.starts, self.ends, self.words = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.slots, self.width = slots, max(slots // cells, 1)
        at = np.arange(-(-slots // self.width) + 1) * self.width
        self.first = np.maximum(np.searchsorted(self.starts, at, "right") - 1, 0)
        self.direct: np.ndarray | None = None

    def slots_of(self, keys: pa.Array, k: int, chunk: int = 65_536) -> np.ndarray:
        """(rows, k) slots from the first k words of 32 bits of the keys' digests; four draws come from one digest."""
        tails = [str(g).encode() for g in range(-(-max(k, 1) // 4))]
        out = np.empty((len(keys), k), np.int64)
        for lo in range(0, len(keys), chunk):
            digits = md5_words(keys.slice(lo, chunk), tails)[:, :k]
            out[lo : lo + chunk] = np.floor(digits / 4294967296.0 * self.slots)
        return out

    def find(self, slots: np.ndarray) -> np.ndarray:
        """Place in the table of each slot's word, -1 without one."""
        if not len(self.words):
            return np.full(slots.shape, -1)
        if self.slots <= DIRECT_SLOTS:
            if self.direct is None:
                self.direct = np.full(self.slots, -1, np.int16 if len(self.words) < 1 << 15 else np.int32)
                for i, (lo, hi) in enumerate(zip(self.starts, self.ends)):
                    self.direct[lo:hi] = i
            return self.direct[slots]
        at = self.first[slots // self.width]
        last = len(self.starts) - 1
        late = np.flatnonzero(self.starts[np.minimum(at + 1, last)] <= slots)
        late = late[at[late] < last]
        while len(late):
            at[late] += 1
            late = late[at[late] < last]
            late = late[self.starts[at[late] + 1] <= slots[late]]
        return np.where((self.starts[at] <= slots) & (slots < self.ends[at]), at, -1)


def _draw_key(seed: int | str) -> Column:
    """Bytes from which a pair's draws are made, up to the number of the digest."""
    return F.concat_ws(":", F.lit(str(seed)), F.lit("n"), *[F.col(c).cast("string") for c in ("doc_id", "place", "shift")], F.lit("")).cast("binary")


def negative_samples(pairs: DataFrame, table: DataFrame, k: int, slots: int = SLOTS, seed: int | str = 42, cells: int = 65_536) -> DataFrame:
    """k draws from the sampling table per pair, the positive word not excluded.

    A drawn slot finds its word in the table, which all tasks get; a pair's draws are looked up together and
    come back as two plain arrays, and nothing is shuffled.
    """
    ship_code(pairs.sparkSession)
    found = _SlotWords(table, slots, cells)
    word = dict(table.dtypes)["word_id"]

    @F.arrow_udf("struct<slot:array<bigint>,negative:array<bigint>>")
    def draws(keys: pa.Array) -> pa.Array:
        slot = found.slots_of(keys, k).ravel()
        at = found.find(slot)
        negative = pa.array(found.words[at], mask=at < 0) if len(found.words) else pa.nulls(len(slot), pa.int64())
        ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * k)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(slot)), pa.ListArray.from_arrays(ends, negative)], ["slot", "negative"])

    # Or a filter on the result would have the draws made once more.
    made = draws.asNondeterministic()(_draw_key(seed))
    drawn = pairs.withColumn("_draws", made).select(*pairs.columns, "_draws", F.posexplode("_draws.slot").alias("_at", "slot"))
    negative = F.get("_draws.negative", F.col("_at"))
    return drawn.select(*pairs.columns, (F.col("_at") + 1).alias("draw"), "slot", negative.cast(word).alias("negative")).filter("negative IS NOT NULL")


#: Examples counted at once, those of them packed at once, and cells of center and other word in a share of the counting, at most.
FLUSH_EXAMPLES, PACK_EXAMPLES, SHARE_CELLS = 1 << 22, 1 << 23, 1 << 21


def _counts(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(times[order], starts) if len(keys) else times


# --- packed examples -------------------------------------------------------------------------
#
# Words are dealt into parts by id. An example's block is that of its center's part and of how many parts its other
# word is further on. A piece holds some examples of one block: their codes in order, as steps from one to the next.

PIECE = "block int, width int, steps binary, leaps binary"


def _pieces(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(block, width, steps, leaps) of examples, given by keys of center, other word and label as often as they are met."""
    n = np.uint32(parts)
    center, other, label = (keys >> 32).astype(np.uint32), (keys >> 1 & 0x7FFFFFFF).astype(np.uint32), (keys & 1).astype(np.uint8)
    deep, width = (int(x.max()) // parts + 1 for x in (center, other))
    cells = deep * width * 2
    kind = np.uint32 if parts * parts * cells < 1 << 32 else np.uint64
    cw, ow = center // n, other // n
    center -= cw * n
    other -= ow * n
    codes = (center * n + (other + n - center) % n).astype(kind)
    for size, place in ((deep, cw), (width, ow), (2, label)):
        codes *= kind(size)
        codes += place
    codes.sort()
    edges = np.searchsorted(codes, (np.arange(parts * parts + 1, dtype=np.uint64) * np.uint64(cells)).astype(kind))
    for block in np.flatnonzero(np.diff(edges)).tolist():
        step = np.diff(codes[edges[block] : edges[block + 1]], prepend=kind(block * cells))
        leaps = step[step >= 255].astype(np.uint32 if cells < 1 << 32 else np.uint64)
        yield block, width, np.minimum(step, kind(255)).astype(np.uint8).tobytes(), leaps.tobytes()


def piece_examples(width: int, steps: bytes, leaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(center, other, label, times) of a piece's distinct examples, words by their place in their part."""
    step = np.frombuffer(steps, np.uint8).astype(np.int64)
    far = step == 255
    n = int(far.sum())
    step[far] = np.frombuffer(leaps, np.uint64 if n and len(leaps) == 8 * n else np.uint32)
    first = step > 0
    first[:1] = True
    at = np.flatnonzero(first)
    codes = np.cumsum(step)[at]
    center, other = np.divmod(codes >> 1, width)
    return center, other, codes & 1, np.diff(at, append=len(step))


def sampled_examples(
    pairs: DataFrame, table: DataFrame, k: int, slots: int = SLOTS, seed: int | str = 42, by: Sequence[str] = (), cells: int = 65_536, parts: int | None = None
) -> DataFrame:
    """The same rows as ``training_examples`` over ``negative_samples``, in one pass over ``pairs``.

    A task draws and counts examples some millions at a time, and deals the counts, packed, into shares of center
    words and ``by``; a share is added up as it comes. So neither draws nor examples are shuffled as rows. Word ids are whole
    numbers below 2^31. With ``parts`` the examples stay packed, as ``PIECE`` rows for the blocks of so many parts
    of the words, which add them up themselves.
    """
    ship_code(pairs.sparkSession)
    found = _SlotWords(table, slots, cells)
    by = list(by)
    kinds = dict(pairs.dtypes)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(tasks, min(len(found.words) ** 2 // SHARE_CELLS, 4096))
    most = FLUSH_EXAMPLES if parts is None else PACK_EXAMPLES

    def packed(held: list[tuple[np.ndarray, np.ndarray]], name: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """One group's examples, (keys of center, other and label), cut into shares of centers or into blocks."""
        if parts is not None:
            for piece in _pieces(np.concatenate([x for x, _ in held]), parts):
                yield pa.RecordBatch.from_arrays([*(name.column(i) for i in range(len(by))), *map(pa.array, zip(piece), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], [*by, "block", "width", "steps", "leaps"])
            return
        keys, times = _counts(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        share = (keys >> 32) % shares
        order = np.argsort(share, kind="stable")
        names, starts = np.unique(share[order], return_index=True)
        pieces = list(zip(np.split(keys[order], starts[1:]), np.split(times[order], starts[1:])))
        columns = [name.column(i).take(pa.array(np.zeros(len(names), np.int64))) for i in range(len(by))]
        columns += [pa.array(names.astype(np.int32)), *(pa.array([p[i].tobytes() for p in pieces], pa.binary()) for i in range(2))]
        yield pa.RecordBatch.from_arrays(columns, [*by, "_share", "_keys", "_times"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.RecordBatch, list]] = {}
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            names = batch.select(by)
            groups = names.to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(batch), np.int64)
            center, context = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("center", "context"))
            at = found.find(found.slots_of(batch.column("_key"), k).ravel())
            hit = at >= 0
            # A key holds the center, the other word and the label.
            keys = np.concatenate([center << 32 | context << 1 | 1, np.repeat(center, k)[hit] << 32 | found.words[at[hit]] << 1])
            where = np.concatenate([groups, np.repeat(groups, k)[hit]])
            for g, first in zip(*np.unique(groups, return_index=True)):
                name = names.slice(first, 1)
                _, waiting = held.setdefault(tuple(name.to_pylist()[0].values()) if by else (), (name, []))
                own = keys[where == g] if by else keys
                waiting.append((own, np.ones(len(own), np.int64) if parts is None else None))
            size += len(keys)
            if size >= most:
                for name, waiting in held.values():
                    yield from packed(waiting, name)
                held, size = {}, 0
        for name, waiting in held.values():
            yield from packed(waiting, name)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed counts in order of ``by`` and share: each group's are summed, and leave as rows."""
        name, now, keys, times, waiting, size = None, None, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 1 << 20):
                part = keys[lo : lo + (1 << 20)]
                columns = [name.column(i).take(pa.array(np.zeros(len(part), np.int64))) for i in range(len(by))]
                columns += [pa.array(part >> 32), pa.array((part & 0xFFFFFFFF) >> 1), pa.array((part & 1).astype(np.int32)), pa.array(times[lo : lo + len(part)])]
                yield pa.RecordBatch.from_arrays(columns, [*by, "center", "other", "label", "times"])

        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                key = tuple(row[c] for c in [*by, "_share"])
                more = tuple(np.frombuffer(row[c], np.int64) for c in ("_keys", "_times"))
                if now != key:
                    if now is not None:
                        keys, times = _counts(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([times, *(x for _, x in waiting)]))
                        yield from rows()
                    name, now, waiting, size = one.select(by), key, [], 0
                    keys = times = np.zeros(0, np.int64)
                waiting.append(more)
                size += len(more[0])
                if size > max(len(keys), FLUSH_EXAMPLES):
                    keys, times = _counts(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([times, *(x for _, x in waiting)]))
                    waiting, size = [], 0
        if now is not None:
            keys, times = _counts(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([times, *(x for _, x in waiting)]))
            yield from rows()

    named = "".join(f"`{c}` {kinds[c]}, " for c in by)
    drawn = pairs.select(*by, F.col("center").cast("bigint").alias("center"), F.col("context").cast("bigint").alias("context"), _draw_key(seed).alias("_key"))
    if parts is not None:
        return drawn.mapInArrow(tally, f"{named}{PIECE}")
    counts = drawn.mapInArrow(tally, f"{named}_share int, _keys binary, _times binary")
    dealt = counts.repartition(shares, *by, "_share").sortWithinPartitions(*by, "_share")
    return dealt.mapInArrow(added, f"{named}center bigint, other bigint, label int, times bigint")


def training_examples(pairs: DataFrame, negatives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive and negative (center, other, label) rows with how often each occurs.

    Equal rows are counted map-side; within one step they share the same gradient. ``by`` names columns
    to keep apart, such as the step.
    """
    positive = pairs.select(*by, "center", F.col("context").alias("other"), F.lit(1).alias("label"))
    negative = negatives.select(*by, "center", F.col("negative").alias("other"), F.lit(0).alias("label"))
    return positive.unionByName(negative).groupBy(*by, "center", "other", "label").agg(F.count(F.lit(1)).alias("times"))
