"""Hard-negative mining by slot-decomposed selection.

Every anchor has a few positives, its best rows of the same label. A positive with score p admits the
rows of other labels that score between 80 % of p and p. These windows overlap, so they are not searched
one by one: the positives' upper limits cut the scores into disjoint slots, every task keeps the best k
rows per anchor and slot, and the k best below a limit are the first k of the slots below it, taken from
the highest down. One pass over the rows therefore answers all windows; a lower limit only ends the list.

Anchors stand in blocks of ``ANCHOR_BLOCK`` and rows in shards of about ``SHARD_ROWS``. Every block meets
every shard, as exact mining asks for: the anchors of a block come first and stay in memory, the rows of
the shard stream past them and meet them as one matrix product a batch. A task emits at most k rows per
anchor and slot, whatever the rows' number or the labels' sizes. A row travels once per block of anchors.

Scores: components become floor(256 x); products of integers are exact, in double precision while they stay
below 2^53, else as Python integers; scores beyond a long stop at its ends.

Nulls: rows with a null id, label or vector, or with null or non-finite components, take no part. Vectors
meet only vectors of their length. Rows repeated count as rows of their own: an anchor's other rows include
copies of itself. An anchor without positives, and a positive without rows in its window, give no rows.
Ties go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, saved
from terralex.llm.vector_blocks import Best, by_length, finite, key_runs, steps

ANCHOR_BLOCK = 16_384
SHARD_ROWS = 16_384
POSITIVES = 5
NEGATIVES = 5
#: A score at most this many cells wide is computed at once.
CELLS = 1 << 21
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def mining_rows(vectors: DataFrame, anchor_every: int = 100, moved_every: int = 7, labels: int = 10) -> DataFrame:
    """row, vec_id, label, embedding and is_anchor of the rows that take part, written once.

    Labels of ids divisible by ``moved_every`` move on by one, which plants wrong labels.
    """
    moved = F.when(F.col("vec_id") % moved_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")
    return saved(
        vectors.filter(fine).select(
            F.monotonically_increasing_id().alias("row"), "vec_id", moved.cast("long").alias("label"), "embedding",
            (F.col("vec_id") % anchor_every == 0).alias("is_anchor"),
        ),
        "mining-rows",
    )


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers."""
    most = max(np.abs(a).max(initial=0.0), 1.0) * max(np.abs(b).max(initial=0.0), 1.0) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, LOWEST + 1, HIGHEST).astype(np.int64)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, shards: int) -> DataFrame:
    """Every block of anchors with every shard of rows, anchors first."""
    pick = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    resident = anchors.select(pick(blocks).alias("block"), every(shards).alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "label", "embedding", "limits")
    passing = rows.select(
        every(blocks).alias("block"), pick(shards).alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "label", "embedding",
        F.lit(None).cast("array<bigint>").alias("limits"),
    )
    return resident.unionByName(passing).repartition("block", "shard").sortWithinPartitions("block", "shard", "kind")


class _Anchors:
    """The anchors of one block and one length, with their best entries so far."""

    def __init__(self, row: np.ndarray, label: np.ndarray, vectors: np.ndarray, limits: list[np.ndarray] | None, k: int):
        order = np.argsort(label, kind="stable")
        self.row, self.label, self.vectors = row[order], label[order], whole(vectors)[order]
        self.slots = 1
        if limits is not None:
            self.slots = max(len(v) for v in limits)
            self.limits = np.full((len(row), self.slots), LOWEST, np.int64)
            for i, j in enumerate(order):
                self.limits[i, : len(limits[j])] = limits[j]
            low = np.where(self.limits >= 0, lower_limit(self.limits), HIGHEST)
            self.top, self.low = self.limits[:, 0], low.min(1)
        self.best = Best(len(row) * self.slots, k, np.int64)

    def meet_same(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of an anchor's label, the anchor itself left out."""
        for name in np.unique(label):
            lo, hi = np.searchsorted(self.label, [name, name + 1])
            here = np.flatnonzero(label == name)
            for a in range(lo, hi, max(1, CELLS // len(here))):
                b = min(hi, a + max(1, CELLS // len(here)))
                score = products(self.vectors[a:b], vectors[here])
                g, r = np.nonzero((score >= self.best.limit[a:b, None]) & (self.row[a:b, None] != row[here][None, :]))
                self.best.offer(a + g, score[g, r], ids[here][r])

    def meet_other(self, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of other labels, each in the slot its score falls in."""
        size = max(1, CELLS // len(ids))
        for a in range(0, len(self.row), size):
            b = min(len(self.row), a + size)
            score = products(self.vectors[a:b], vectors)
            fits = (score <= self.top[a:b, None]) & (score >= self.low[a:b, None]) & (self.label[a:b, None] != label[None, :])
            g, r = np.nonzero(fits)
            found = score[g, r]
            slot = (found[:, None] <= self.limits[a:b][g]).sum(1) - 1
            self.best.offer((a + g) * self.slots + slot, found, ids[r])


def lower_limit(p: np.ndarray) -> np.ndarray:
    """The smallest integers at 80 % of p or above, without products that could overflow."""
    return p - p // 5


def _mined(met: DataFrame, k: int, slots: bool) -> DataFrame:
    """(anchor, slot, score, vec_id): the best k of every anchor and slot in each pair of block and shard."""

    def done(blocks: dict[int, _Anchors]) -> Iterator[pa.RecordBatch]:
        for block in blocks.values():
            group, score, ids, _ = block.best.entries()
            if len(group):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.row[group // block.slots]), pa.array((group % block.slots).astype(np.int32)), pa.array(score), pa.array(ids)],
                    names=["anchor", "slot", "score", "vec_id"],
                )

    def settled(waiting: list[pa.RecordBatch]) -> dict[int, _Anchors]:
        if not waiting:
            return {}
        t = pa.Table.from_batches(waiting).combine_chunks()
        row, label = t["row"].to_numpy(), t["label"].to_numpy()
        limits = [np.array(v, np.int64) for v in t["limits"].to_pylist()] if slots else None
        return {
            dims: _Anchors(row[at], label[at], vectors, [limits[i] for i in at] if slots else None, k)
            for dims, at, vectors in by_length(t["embedding"].combine_chunks())
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, blocks = None, [], {}
        for (block, shard, kind), b in key_runs(batches, ["block", "shard", "kind"]):
            if (block, shard) != now:
                yield from done(blocks)
                now, waiting, blocks = (block, shard), [], {}
            if kind == 0:
                waiting.append(b)
                continue
            if waiting:
                blocks, waiting = settled(waiting), []
            for dims, at, vectors in by_length(b.column("embedding")):
                if dims not in blocks:
                    continue
                row, ids, label = (b.column(c).to_numpy()[at] for c in ("row", "vec_id", "label"))
                vectors = whole(vectors)
                for part in steps(len(at)):
                    if slots:
                        blocks[dims].meet_other(ids[part], label[part], vectors[part])
                    else:
                        blocks[dims].meet_same(row[part], ids[part], label[part], vectors[part])
        yield from done(blocks)

    return met.transform(map_batches, run, "anchor bigint, slot int, score bigint, vec_id bigint")


def best_positives(rows: DataFrame, anchors: DataFrame, blocks: int, shards: int, k: int = POSITIVES) -> DataFrame:
    """(anchor, place, positive_id, positive_score): each anchor's first k other rows of its label."""
    met = _met(rows, anchors.withColumn("limits", F.lit(None).cast("array<bigint>")), blocks, shards)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    found = _mined(met, k, slots=False).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return found.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def suffix_merge(slots: Column, place: Column, positive_score: Column, k: int) -> Column:
    """The first k entries of one window: slots from the positive's own down, ended by the lower limit.

    ``slots`` is an array of (slot, -score, vec_id) in ascending order, so of falling scores. The positive's
    score must not be negative.
    """
    low = positive_score - F.call_function("div", positive_score, F.lit(5))
    inside = F.filter(slots, lambda e: (e["slot"] >= place - 1) & (-e["less"] >= low))
    return F.slice(inside, 1, k)


def mine(rows: DataFrame, k: int = NEGATIVES, positives: int = POSITIVES) -> DataFrame:
    """Hard negatives of every anchor of ``mining_rows``: one row per anchor, positive and rank."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).first()
    blocks, shards = max(1, -(-sizes["a"] // ANCHOR_BLOCK)), max(1, -(-sizes["n"] // SHARD_ROWS))
    anchors = rows.filter("is_anchor")
    good = saved(best_positives(rows, anchors, blocks, shards, positives), "mining-positives")
    limits = good.groupBy("anchor").agg(F.sort_array(F.collect_list("positive_score"), asc=False).alias("limits"))
    # A window with a negative upper limit is empty, so its anchor needs no search on that account.
    asked = anchors.join(limits.filter(F.col("limits")[0] >= 0).withColumnRenamed("anchor", "row"), "row")
    kept = _mined(_met(rows, asked, blocks, shards), k, slots=True)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    per_slot = kept.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    # At most positives * k entries an anchor.
    entry = F.struct("slot", (-F.col("score")).alias("less"), "vec_id")
    slots = per_slot.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("slots"))
    windows = good.filter("positive_score >= 0").join(slots, "anchor").select(
        "anchor", "positive_id", "positive_score", F.posexplode(suffix_merge(F.col("slots"), F.col("place"), F.col("positive_score"), k)).alias("at", "entry")
    )
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return windows.join(names, "anchor").select(
        F.col("anchor_id").cast("long").alias("anchor_id"), F.col("positive_id").cast("long").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.vec_id").cast("long").alias("negative_id"),
        "positive_score", (-F.col("entry.less")).alias("negative_score"),
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(mining_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


#: The same by comparing every anchor with every row.
OP11_SQL = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
           FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND s.score <= p.positive_score AND 100 * s.score >= 80 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
