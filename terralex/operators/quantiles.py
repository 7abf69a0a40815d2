"""Exact quantiles that survive a group holding most of the table.

``percentile`` keeps every distinct value of a group in one buffer. That is right for groups of
bounded size. The distinct values of a larger group are cut into pieces at sketched quantiles; the
counts per piece tell which pieces hold the wanted ranks, and only those are ordered. The cuts only
balance the work, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = 1_000_000
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles of the non-null values."""
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())

    # Equal values are counted first. The shuffle is on key and value, so a large group spreads out,
    # and everything below reads that one shuffle.
    tally = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if not keys:
        return _large_groups(tally, keys, probs, names)
    large = tally.groupBy(*keys).agg(F.sum("_c").alias("_d")).filter(F.col("_d") > group_limit).select(*keys)
    small = (
        tally.join(large, keys, "left_anti")
        .groupBy(*keys)
        .agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_c")).alias("_q"))
        .select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    )
    ranked = _large_groups(tally.join(large, keys), keys, probs, names)
    return small.unionByName(ranked)


def with_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the one row per key of ``facts``; without keys its only row, read as a scalar."""
    if keys:
        return df.join(facts, list(keys))
    return df.withColumn("_facts", global_row(facts)).select("*", "_facts.*").drop("_facts")


def _cut(tally: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Add the key's rows ``_n`` and ``_seg``: which of up to 256 pieces of its values a value is in.

    A value is placed among 15 coarse cuts and then among the 15 finer ones in between.
    """
    cuts = [i / 256 for i in range(1, 256)]
    edges = tally.groupBy(*keys).agg(F.percentile_approx(value, cuts, ACCURACY).alias("_cuts"), F.sum(count).alias("_n"))
    edges = edges.withColumn("_coarse", F.array(*[F.col("_cuts")[16 * i - 1] for i in range(1, 16)]))
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col(value)))
    placed = with_facts(tally, edges, keys).withColumn("_hi", below(F.col("_coarse")))
    fine = below(F.slice("_cuts", F.col("_hi") * 16 + 1, 15))
    return placed.withColumn("_seg", F.col("_hi") * 16 + fine).drop("_cuts", "_coarse", "_hi")


def _piece_starts(placed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(keys…, _seg, _n, _size, _start): how many rows come before each piece."""
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy(*keys, "_seg", "_n").agg(F.sum(count).alias("_size")).select(
        *keys, "_seg", "_n", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )


def _large_groups(tally: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    placed = _cut(tally, keys, "_v", "_c")
    pieces = _piece_starts(placed, keys, "_c")
    asked = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank")) for i, p in enumerate(probs)])
    ends = lambda r: (F.floor(r) < F.col("_start") + F.col("_size")) & (F.ceil(r) >= F.col("_start"))
    wanted = pieces.withColumn("_ask", F.filter(asked, lambda a: ends(a["rank"]))).filter(F.size("_ask") > 0)
    order = Window.partitionBy(*keys, "_seg").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.drop("_n").join(wanted.drop("_n", "_size"), [*keys, "_seg"]).withColumn("_end", F.col("_start") + F.sum("_c").over(order))
    each = run.select(*keys, "_v", "_c", "_end", F.explode("_ask").alias("_a")).select(*keys, "_v", "_c", "_end", "_a.*")
    at = lambda r: F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_v")))
    found = each.groupBy(*keys, "i").agg(at(F.floor("rank")).alias("_lo"), at(F.ceil("rank")).alias("_hi"), F.max("rank").alias("rank"))
    # Weighed as the built-in percentile does, so that both give the same bits.
    part = F.col("rank") - F.floor("rank")
    value = F.when(part == 0, F.col("_lo")).otherwise((F.ceil("rank") - F.col("rank")) * F.col("_lo") + part * F.col("_hi"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(names)])


def medians_wide(df: DataFrame, keys: Sequence[str], cols: Sequence[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact median of several columns per key, in one long-form pass."""
    keys = list(keys)
    long = melt(df, keys, cols)
    med = exact_quantiles(long, [*keys, "col"], "value", [0.5], ["median"], group_limit)
    if not keys:
        return med.agg(*[F.max(F.when(F.col("col") == c, F.col("median"))).alias(c) for c in cols])
    return med.groupBy(*keys).agg(*[F.max(F.when(F.col("col") == c, F.col("median"))).alias(c) for c in cols])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form ``(ids…, col, value)`` without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*ids, F.explode(pairs).alias("_p")).select(*ids, "_p.col", "_p.value")


def global_row(stats: DataFrame) -> Column:
    """A one-row table as a scalar struct, so using it needs no join."""
    return stats.select(F.struct(*stats.columns)).scalar()


def ranked_tally(tally: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Add to one row per key and distinct value how many rows come ``before`` it, and the key's ``n``."""
    keys = list(keys)
    placed = _cut(tally, keys, value, count)
    inside = Window.partitionBy(*keys, "_seg").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    joined = run.join(_piece_starts(placed, keys, count).drop("_n"), [*keys, "_seg"])
    return joined.select(*tally.columns, (F.col("_start") + F.col("_in")).alias("before"), F.col("_n").alias("n"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of every distinct value per key: (keys…, value, n_equal, before, rank, n).

    Equal values are counted first, so a hot value is one row.
    """
    keys = list(keys)
    tally = (
        df.select(*keys, F.col(value).cast("double").alias(value))
        .filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    out = ranked_tally(tally, keys, value, "n_equal")
    return out.withColumn("rank", F.col("before") + (F.col("n_equal") + 1) / F.lit(2.0))
