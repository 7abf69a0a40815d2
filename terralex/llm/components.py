"""Connected components of a link table by alternating large and small stars.

Every round rewires each node's links to the smallest node it knows, first for larger and then for
smaller neighbours, until every component is a star around its smallest node. A round is two
minimum aggregations with partial sums and two joins, so a node with very many links is combined
before the shuffle, and its rows may be split in the joins. No group is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import saved


def _tally(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest node of the neighbourhood."""
    around = _both_ways(links)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return around.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, move to the smallest of them. ``links`` has u < v."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    others = links.join(least, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    own = least.select(F.col("m").alias("u"), "v")
    return others.unionByName(own).distinct()


def components(links: DataFrame, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u and v, any order) but the roots themselves.

    ``root`` is the smallest node reachable. Self links and repeats are ignored.
    """
    now = saved(
        links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), name
    )
    before = _tally(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = saved(_small_star(_large_star(now)), name)
        after = _tally(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
