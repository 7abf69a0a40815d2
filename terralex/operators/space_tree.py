"""Nearest references through an adaptive space tree.

Space is halved at medians of a sample, along its widest axis, until a leaf holds about ``LEAF_ROWS``
references; empty space is not cut and crowded space is cut finely. Where many places share a value of an axis, the
cut goes beside that value, or along another axis, so that both sides hold places. The tree is a bounded table that all tasks
get. An ask first meets its own leaf, whose k-th nearest reference bounds its search, then the other leaves
that bound reaches, and nothing else. Leaves with many asks are met in shards. A pair costs work only
inside a leaf, as one block of distances; what a task keeps is a leaf, and what it emits is about k rows an ask.

Up to ``FEW`` references are sent to all tasks with the tree, and asks meet them where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.session import cut_lineage, ship_code

LEAF_ROWS = 512
SAMPLE_PER_LEAF = 8
#: A cut that leaves a side with a smaller share of the places gives way to one along a narrower axis.
LEAST_SIDE = 0.2
#: The tree's size bound: leaves, and rows of the sample, that the driver holds.
MOST_LEAVES = 1 << 16
ASK_ROWS = 8192
#: References that may be sent to all tasks.
FEW = 1 << 16
#: Distances computed at once.
CELLS = 1 << 20
#: Groups stand apart by this much on an axis of their own, farther than any two places of one group.
APART = float(1 << 24)


def _halving(x: np.ndarray) -> tuple[int, float]:
    """The axis and cut of points: the widest axis whose smaller side holds ``LEAST_SIDE`` of them, or else the most even one."""
    best = (-1, 0, 0.0)
    for axis in np.argsort(-np.ptp(x, axis=0), kind="stable"):
        v = x[:, axis]
        middle = np.median(v)
        above = v[v > middle]
        for cut in (middle, above.min()) if len(above) else (middle,):
            right = int((v >= cut).sum())
            best = max(best, (min(right, len(v) - right), -int(axis), float(cut)), key=lambda b: b[0])
        if best[0] >= LEAST_SIDE * len(v):
            break
    return -best[1], best[2]


@dataclass(frozen=True)
class SpaceTree:
    """A complete binary tree of cuts, in heap order."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, depth: int) -> SpaceTree:
        axis, cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        held = {0: points}
        for node in range(len(cut)):
            x = held.pop(node)
            if not len(x):
                x = np.zeros((1, points.shape[1]))
            axis[node], cut[node] = _halving(x)
            right = x[:, axis[node]] >= cut[node]
            held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
        return cls(depth, axis, cut)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)

    def touched(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, leaf) of every leaf that the cube of ``reach`` around a point meets; the last axis reaches half of ``APART`` at most."""
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at, cut = self.axis[node], self.cut[node]
            far = np.where(at == x.shape[1] - 1, np.minimum(reach[who], APART / 2), reach[who])
            left, right = x[who, at] - far < cut, x[who, at] + far >= cut
            who, node = np.concatenate([who[left], who[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return who, node - (2**self.depth - 1)


def _distances(a: np.ndarray, b: np.ndarray, chebyshev: bool) -> np.ndarray:
    """Squared or largest distances of all rows on all but the last axis; infinite between groups."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1] - 1):
        step = a[:, d : d + 1] - b[None, :, d]
        out = np.maximum(out, np.abs(step)) if chebyshev else out + step * step
    out[a[:, -1:] != b[None, :, -1]] = np.inf
    return out


def kth_distance(dist: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The distance within which each row has k references, copies counted; infinite if there are fewer."""
    width = min(k, dist.shape[1])
    near = np.argpartition(dist, width - 1, axis=1)[:, :width]
    d = np.take_along_axis(dist, near, 1)
    order = np.argsort(d, axis=1, kind="stable")
    d, held = np.take_along_axis(d, order, 1), np.cumsum(np.take_along_axis(copies[near], order, 1), axis=1)
    enough = (held >= k) & np.isfinite(d)
    first = enough.argmax(1)
    return np.where(enough.any(1), d[np.arange(len(d)), first], np.inf)


class _Few:
    """A bounded number of references, sorted by leaf."""

    def __init__(self, rows: pd.DataFrame, depth: int, place: Sequence[str]):
        axes = np.stack(rows["_axes"].to_numpy()) if len(rows) else np.zeros((0, 1))
        self.tree = SpaceTree.over(axes, depth)
        leaf = self.tree.leaf(axes)
        order = np.argsort(leaf, kind="stable")
        self.ends = np.searchsorted(leaf[order], np.arange(2**depth + 1))
        self.axes, self.copies = axes[order], rows["_copies"].to_numpy()[order]
        self.place = {c: rows[c].to_numpy()[order] for c in place}

    def _blocks(self, who: np.ndarray, leaves: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
        """Asks that meet one leaf, in pieces, with the leaf's references."""
        order = np.argsort(leaves, kind="stable")
        names, first = np.unique(leaves[order], return_index=True)
        for name, asks in zip(names, np.split(who[order], first[1:])):
            refs = slice(self.ends[name], self.ends[name + 1])
            size = max(1, CELLS // max(refs.stop - refs.start, 1))
            for lo in range(0, len(asks) if refs.stop > refs.start else 0, size):
                yield asks[lo : lo + size], refs

    def pairs(self, batch: pd.DataFrame, names: Sequence[str], k: int, chebyshev: bool) -> pd.DataFrame:
        x = np.stack(batch["_axes"].to_numpy())
        reach = np.full(len(x), np.inf)
        for asks, refs in self._blocks(np.arange(len(x)), self.tree.leaf(x)):
            reach[asks] = kth_distance(_distances(x[asks], self.axes[refs], chebyshev), self.copies[refs], k)
        reach = reach * (1 + 1e-9) + 1e-18
        a, r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for asks, refs in self._blocks(*self.tree.touched(x, (reach if chebyshev else np.sqrt(reach)) * (1 + 1e-9))):
            dist = _distances(x[asks], self.axes[refs], chebyshev)
            limit = np.minimum(reach[asks], kth_distance(dist, self.copies[refs], k) * (1 + 1e-9) + 1e-18)
            i, j = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
            a.append(asks[i])
            r.append(refs.start + j)
        a, r = np.concatenate(a), np.concatenate(r)
        out = batch[list(names)].iloc[a].reset_index(drop=True)
        out["_reach"], out["_copies"] = reach[a], self.copies[r]
        for c, v in self.place.items():
            out[f"_r{c}"] = v[r]
        return out


def _leaf_of(tree: SpaceTree):
    @F.pandas_udf("int")
    def leaf(axes: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(np.stack(axes.to_numpy())).astype(np.int32)) if len(axes) else pd.Series([], dtype="int32")

    return leaf


def _met(asks: DataFrame, refs: DataFrame, tasks: int) -> DataFrame:
    """References and asks of every leaf and shard, references first. Both have ``_leaf``."""
    sizes = asks.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("_shards"))
    resident = refs.join(sizes, "_leaf").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))).withColumn("_kind", F.lit(0))
    passing = asks.join(sizes, "_leaf").withColumn("_shard", F.pmod(F.xxhash64("_axes", "_leaf"), F.col("_shards")).cast("int")).withColumn("_kind", F.lit(1))
    met = resident.unionByName(passing, allowMissingColumns=True).drop("_shards")
    return met.repartition(tasks, "_leaf", "_shard").sortWithinPartitions("_leaf", "_shard", "_kind")


def _leaf_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """(reference axes, copies, reference rows, ask rows, ask axes) of each leaf and shard, asks in pieces."""
    now, waiting, refs = None, [], None
    for batch in batches:
        for key, part in batch.groupby(["_leaf", "_shard", "_kind"], sort=True):
            if key[:2] != now:
                now, waiting, refs = key[:2], [], None
            if key[2] == 0:
                waiting.append(part)
                continue
            if waiting:
                refs, waiting = pd.concat(waiting), []
                axes, copies = np.stack(refs["_axes"].to_numpy()), refs["_copies"].to_numpy()
            if refs is None:
                axes, copies = np.zeros((0, len(part["_axes"].iloc[0]))), np.zeros(0, np.int64)
            size = max(1, CELLS // max(len(axes), 1))
            for lo in range(0, len(part), size):
                piece = part.iloc[lo : lo + size]
                yield axes, copies, refs, piece, np.stack(piece["_axes"].to_numpy())


def nearest_pairs(
    asks: DataFrame, refs: DataFrame, place: Sequence[str], axes: Column, k: int, by: Sequence[str] = (), copies: Column | None = None,
    chebyshev: bool = False,
) -> DataFrame:
    """Pairs of places that hold each ask's k nearest references, ties and a few more included.

    ``place`` names the columns of a place, distinct in ``asks`` and in ``refs``; ``axes`` are its coordinates,
    in which nearness is measured. Only places equal in ``by`` meet; the groups' hashes tell them apart.
    ``copies`` counts the references at a place. Returns the columns of ``by``, the ask's place, the
    reference's place with ``_r`` in front, and ``_reach``: a bound of the k-th distance (squared if not
    ``chebyshev``), null where there are fewer than k, and ``_copies`` of the reference.
    """
    by, place = list(by), list(place)
    spark = asks.sparkSession
    ship_code(spark)
    # The group's axis spreads hashes over places far apart; equal hashes are one group.
    group = F.pmod(F.xxhash64(*by), F.lit(1 << 28)).cast("double") * APART if by else F.lit(0.0)
    spot = F.concat(axes, F.array(group))
    refs = cut_lineage(refs.select(*by, *place, (copies if copies is not None else F.lit(1)).cast("long").alias("_copies"), spot.alias("_axes")))
    n = refs.count()
    names = [*by, *place]
    kinds = dict(asks.dtypes)
    row = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    pairs_row = f"{row}, _reach double, _copies bigint, " + ", ".join(f"_r{c} {kinds[c]}" for c in place)
    bounded = F.when(F.col("_reach") < float("inf"), F.col("_reach")).alias("_reach")
    out = [*names, bounded, "_copies", *[f"_r{c}" for c in place]]
    leaf_rows = max(LEAF_ROWS, 4 * k)
    depth = min(max(0, math.ceil(math.log2(n / leaf_rows))) if n > leaf_rows else 0, int(math.log2(MOST_LEAVES)))
    if n <= FEW:
        few = _Few(refs.select(*place, "_copies", "_axes").toPandas(), depth, place)

        def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and n:
                    yield few.pairs(batch, names, k, chebyshev)

        return asks.select(*names, spot.alias("_axes")).mapInPandas(met, pairs_row).select(*out)
    share = min(1.0, SAMPLE_PER_LEAF * 2.0**depth / max(n, 1))
    drawn = refs.filter(F.pmod(F.xxhash64("_axes"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("_axes").toPandas()["_axes"] if depth else []
    tree = SpaceTree.over(np.stack(list(drawn)) if len(drawn) else np.zeros((1, 1)), depth if len(drawn) else 0)
    leaf = _leaf_of(tree)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(refs.withColumn("_leaf", leaf("_axes")))
    own = asks.select(*by, *place, spot.alias("_axes")).withColumn("_leaf", leaf("_axes"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for axes, copies, _, piece, x in _leaf_runs(batches):
            bound = kth_distance(_distances(x, axes, chebyshev), copies, k) if len(axes) else np.full(len(x), np.inf)
            # Rounding must not part equal distances.
            wide = bound * (1 + 1e-9) + 1e-18
            who, leaves = tree.touched(x, (wide if chebyshev else np.sqrt(wide)) * (1 + 1e-9))
            order = np.argsort(who, kind="stable")
            cuts = np.cumsum(np.bincount(who, minlength=len(x)))[:-1]
            out = piece[[*names, "_axes"]].copy()
            out["_reach"] = wide
            out["_leaves"] = np.split(leaves[order].astype(np.int32), cuts)
            yield out

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for axes, copies, refs, piece, x in _leaf_runs(batches):
            if not len(axes):
                continue
            dist = _distances(x, axes, chebyshev)
            limit = np.minimum(piece["_reach"].to_numpy(), kth_distance(dist, copies, k) * (1 + 1e-9) + 1e-18)
            a, r = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
            out = piece[[*names, "_reach"]].iloc[a].reset_index(drop=True)
            out["_copies"] = copies[r]
            for c in place:
                out[f"_r{c}"] = refs[c].to_numpy()[r]
            yield out

    rounds = cut_lineage(_met(own, placed, tasks).mapInPandas(reach, f"{row}, _axes array<double>, _reach double, _leaves array<int>"))
    looks = rounds.withColumn("_leaf", F.explode("_leaves")).drop("_leaves")
    return _met(looks, placed, tasks).mapInPandas(found, pairs_row).select(*out)
