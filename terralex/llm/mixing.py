"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are hashed to shards of about equal word counts. Inside a shard, blocks of equal token
count go to the sources by highest quotients, which gives an integer quota for each (shard, source).
The documents of such a cell, in seeded order, form a tape of blocks; the quota takes its first
blocks, and the tape runs twice at most.

Nulls: a null text has no words, a null source is a source of its own (the last one), a null id is
hashed like any value. A document without words has nothing to take. Rows repeated in every column
are rows of their own. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import saved, word_count
from terralex.operators.scan import dense_position

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 16
SEED = 20240


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING
) -> DataFrame:
    """(source, source_no, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    words. A target stops at ``ceiling`` times its source; the excess is shared out again by weight
    until no target is above. Each round is one aggregate over one row per source.
    """
    if not 0 <= share <= ceiling:
        raise ValueError("share must lie between 0 and the ceiling, or no mix can reach it")
    per = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # Numbers follow the order of (null last, source); segments are the sources' first two characters.
    keyed = per.withColumns(
        {"_one": F.lit(1), "_null": F.col("source").isNull().cast("int"), "_head": F.substring("source", 1, 2)}
    )
    numbered = dense_position(keyed, ["_one"], ["_null", "source"], F.struct("_null", "_head"), "source_no")
    parts = F.array(*[F.lit(float(w)) for w in weights])
    numbered = numbered.select(
        "source",
        F.col("source_no").cast("long"),
        "source_size",
        F.element_at(parts, (F.col("source_no") % len(weights) + 1).cast("int")).alias("_weight"),
    )
    numbered = saved(numbered, "mix-numbered")
    top = ceiling * F.col("source_size")
    total, weight = numbered.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = share * (total or 0) / weight if weight else 0.0
    while total:
        full = top <= level * F.col("_weight")
        fixed, free = numbered.agg(
            F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))
        ).first()
        raised = (share * total - fixed) / free if free else level
        if raised <= level:
            break
        level = raised
    return numbered.select("source", "source_no", "source_size", F.least(top, F.lit(level) * F.col("_weight")).alias("target"))


def shard_quotas(cells: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Blocks for each (shard, source_no) by highest quotients votes / 1, / 3, / 5 ...

    A shard has as many blocks as its votes fill. Seats that any divisor within half a seat per
    source gives are safe, so only about two candidates per source are ranked.
    """
    shard = Window.partitionBy("shard")
    votes, k = F.sum("votes").over(shard), F.count(F.lit(1)).over(shard)
    blocks = F.floor(F.col("_votes") / block + 0.5)

    def seats(divisor):
        return F.when(divisor > 0, F.floor(F.col("votes") / divisor + 0.5)).otherwise(F.lit(0)).cast("long")

    with_bounds = (
        cells.withColumns({"_votes": votes, "_k": k})
        .withColumn("_blocks", blocks)
        .withColumn("_low", F.greatest(F.lit(0), seats(F.try_divide("_votes", F.greatest(F.col("_blocks") - F.col("_k") / 2, F.lit(0.0)))) - 1))
        .withColumn("_high", seats(F.try_divide("_votes", F.col("_blocks") + F.col("_k") / 2)) + 1)
        .withColumn("_left", F.col("_blocks") - F.sum("_low").over(shard))
    )
    seat = with_bounds.withColumn(
        "_seat",
        F.explode_outer(F.when((F.col("votes") > 0) & (F.col("_high") > F.col("_low")), F.sequence(F.col("_low") + 1, F.col("_high")))),
    )
    quotient = F.col("votes") / (2 * F.col("_seat") - 1)
    rank = F.row_number().over(shard.orderBy(quotient.desc_nulls_last(), "source_no", "_seat"))
    won = F.col("_seat").isNotNull() & (rank <= F.col("_left"))
    return (
        seat.withColumn("_won", won.cast("long"))
        .groupBy("shard", "source_no", "words")
        .agg((F.max("_low") + F.sum("_won")).alias("quota"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken and the row's hash ``row_hash``.

    ``docs`` has doc_id, source and text. ``taken`` counts words, repeats included, and is at most
    ``ceiling`` (2) times ``size``.
    """
    if ceiling != 2.0:
        raise ValueError("the tape runs twice")
    thin = saved(
        docs.select(
            "doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("row_hash")
        ),
        "mix-sizes",
    )
    targets = saved(source_targets(thin.select("source", "size"), weights, share, ceiling), "mix-targets")
    words = thin.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    t = targets.withColumnRenamed("source", "_source")
    placed = thin.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("shard", F.pmod("row_hash", F.lit(shards)))
    cells = placed.groupBy("shard", "source_no").agg(
        F.sum("size").alias("words"),
        F.sum(F.when(F.col("source_size") > 0, F.col("target") * F.col("size") / F.col("source_size")).otherwise(0.0)).alias("votes"),
    )
    quotas = saved(shard_quotas(cells, block), "mix-quotas")
    tape = Window.partitionBy("shard", "source_no").orderBy("row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.join(quotas, ["shard", "source_no"]).withColumn("_start", F.sum("size").over(tape) - F.col("size"))
    end = F.col("quota") * block
    once = F.least(F.greatest(end - F.col("_start"), F.lit(0)), F.col("size"))
    again = F.least(F.greatest(end - F.col("words") - F.col("_start"), F.lit(0)), F.col("size"))
    return laid.select(
        "doc_id", "size", "source", "source_size", "target", (once + again).cast("long").alias("taken"), "row_hash"
    )


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix as rows: every document as often as its taken words round to whole copies (0, 1 or 2).

    All columns of ``docs`` stay. A document without words is kept once, as it has no share to cut.
    """
    taken = mix(docs, seed=seed, **options)
    copies = (
        taken.groupBy("doc_id", "row_hash")
        .agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
        .select(
            F.col("doc_id").alias("_id"),
            "row_hash",
            F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(1).cast("int").alias("_copies"),
        )
        .filter("_copies > 0")
    )
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_hash"))
    kept = rows.join(copies, (F.col("_hash") == F.col("row_hash")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source", "source_size", "target", "taken")
