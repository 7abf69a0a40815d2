"""Ordered computations that never need a whole group in one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task, which fails when one key
holds a large part of the table. The helpers here cut each key's order into segments, work inside
``(key, segment)``, and carry one summary row per segment across the key. A segment is any column
that does not decrease along the order, such as a block of calendar days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.session import cut_lineage

SEG = "_scan_seg"
SEGMENT_DAYS = 30


def day_segment(day: Column, days: int = SEGMENT_DAYS) -> Column:
    """Calendar block of a date: non-decreasing along time, at most ``days`` days each."""
    return F.floor(F.unix_date(day) / F.lit(days)).cast("int")


def block_segment(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def _ordering(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    cols: dict[str, Column],
    include_current: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Add, per entry of ``cols``, its last non-null value in earlier rows of the key.

    ``reverse`` looks at later rows instead (the nearest one). ``order`` must be unique per key.
    """
    keys, order = list(keys), list(order)
    tagged = df.withColumn(SEG, segment).withColumns({f"_src_{n}": c for n, c in cols.items()})
    inside = Window.partitionBy(*keys, SEG).orderBy(*_ordering(order, reverse))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    across = Window.partitionBy(*keys).orderBy(*_ordering([SEG], reverse))
    across = across.rowsBetween(Window.unboundedPreceding, -1)

    # A plain ordering column keeps the aggregate hashed; a struct would have it sort.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    held = {n: pick(F.col(f"_src_{n}"), F.when(F.col(f"_src_{n}").isNotNull(), place)) for n in cols}
    summary = tagged.groupBy(*keys, SEG).agg(*[v.alias(f"_sum_{n}") for n, v in held.items()])
    carried = summary.select(
        *keys, SEG, *[F.last(f"_sum_{n}", ignorenulls=True).over(across).alias(f"_car_{n}") for n in cols]
    )
    local = tagged.withColumns(
        {f"_loc_{n}": F.last(f"_src_{n}", ignorenulls=True).over(inside) for n in cols}
    )
    joined = local.join(carried, [*keys, SEG], "left")
    return joined.select(
        *df.columns, *[F.coalesce(f"_loc_{n}", f"_car_{n}").alias(n) for n in cols]
    )


def dense_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str = "pos"
) -> DataFrame:
    """Zero-based row number within the key, from per-segment numbers and segment offsets."""
    keys, order = list(keys), list(order)
    tagged = df.withColumn(SEG, segment)
    inside = Window.partitionBy(*keys, SEG).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, SEG)
        .agg(F.count(F.lit(1)).alias("_scan_n"))
        .select(*keys, SEG, F.coalesce(F.sum("_scan_n").over(across), F.lit(0)).alias("_scan_off"))
    )
    numbered = tagged.withColumn("_scan_rn", F.row_number().over(inside))
    return numbered.join(offsets, [*keys, SEG]).select(
        *df.columns, (F.col("_scan_off") + F.col("_scan_rn") - 1).cast("bigint").alias(name)
    )


def numbered(df: DataFrame, order: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Rows numbered from 0 without gaps, along ``order`` if one is given.

    Rows are dealt by a sampled range of ``order`` and sorted inside the partitions, whose sizes are summed
    up; no task sees more than its partition, and the sums are one row per partition. The rows are
    checkpointed in between, so their numbers stay the same when a task is repeated. Equal rows of
    ``order`` are numbered as they come.
    """
    order = list(order)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = cut_lineage(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the table.
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + inside).alias(name))


def position_across(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 without gaps over the whole table, along ``keys``, then ``order``.

    Rows are numbered inside ``(key, segment)``. How many come before is summed up over one row per key and segment and
    meets the rows as a first row of theirs, so they are shuffled once and nothing of their size is kept. ``segment`` must not
    decrease along ``order``; equal rows are numbered as they come.
    """
    keys, order = list(keys), list(order)
    tagged = df.withColumn("_scan_part", segment)
    sizes = tagged.groupBy(*keys, "_scan_part").agg(F.count(F.lit(1)).alias("_scan_n"))
    ends = running_sum(sizes, [], [*keys, "_scan_part"], "_scan_n", "_scan_end")
    starts = ends.select(*keys, "_scan_part", (F.col("_scan_end") - F.col("_scan_n")).alias("_scan_start"))
    both = tagged.withColumn("_scan_start", F.lit(None).cast("bigint")).unionByName(starts, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_scan_part").orderBy(F.col("_scan_start").asc_nulls_last(), *order)
    before = F.max("_scan_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_scan_place", before + F.row_number().over(inside) - 2).filter("_scan_start IS NULL")
    return placed.select(*df.columns, F.col("_scan_place").cast("bigint").alias(name))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """The sum of ``value`` over a row and all rows of its key before it; equal rows come in any order.

    Rows are dealt by a sampled range of key and order. A range is a segment: it is summed up by itself, and
    one row per key and segment carries the sums on.
    """
    keys, order = list(keys), list(order)
    dealt = df.repartitionByRange(*keys, *order).withColumn(SEG, F.spark_partition_id())
    placed = cut_lineage(dealt)
    inside = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*keys, SEG).agg(F.sum(value).alias("_size")).select(*keys, SEG, F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_before"))
    return placed.withColumn("_in", F.sum(value).over(inside)).join(before, [*keys, SEG]).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def with_halo(
    df: DataFrame, pos: str, block: int, before: int = 0, after: int = 0, name: str = "_block"
) -> DataFrame:
    """Assign rows to blocks of ``block`` positions, copying the edge rows neighbours need.

    A frame of up to ``before`` earlier and ``after`` later positions is then complete inside
    ``(key, block)`` for every row with ``_core`` true; copies have it false. ``block`` must be at
    least as large as both edges, so a row has at most two copies.
    """
    if before > block or after > block:
        raise ValueError("block must be at least as large as the frame")
    own = F.floor(F.col(pos) / F.lit(block)).cast("bigint")
    place = F.pmod(F.col(pos), F.lit(block))
    late, early = place >= block - before, place < after
    # Plain arrays: a function over array items would be interpreted row by row.
    copies = F.when(late & early, F.array(own, own + 1, own - 1)).when(late, F.array(own, own + 1)).when(early, F.array(own, own - 1)).otherwise(F.array(own))
    out = df.withColumn(name, F.explode(copies))
    return out.withColumn("_core", F.col(name) == own)
