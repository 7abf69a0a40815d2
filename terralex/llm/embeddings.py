"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected by random orthonormal rows to blocks of eight dimensions, and each block
is decoded to its nearest E8 lattice point. A table's cell is the pair of its two blocks' points; a
vector stands in its own cell and in the neighbouring cells nearest to it, in several tables. Vectors
of one label that share a cell are compared by exact cosine in double precision.

Equal vectors of a label are one node with a multiplicity. A crowded cell is cut into blocks of
``BLOCK_ROWS`` rows and every pair of blocks is a group of its own. A group emits no pairs, but per
node the number of links and the smallest node reachable inside the group. A pair that shares several
cells counts in the one with the smallest code only.

Nulls: a vector links with nothing if it is null, zero or holds null or non-finite components, or if
its label or id is null; it is then its own component. Vectors of different lengths never link. Rows
repeated count as vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, saved
from terralex.llm.components import components

THRESHOLD = 0.93
TABLES = 8
PROBES = 3
BLOCKS = 2
SCALE = 0.30
SEED = 88
BLOCK_ROWS = 512


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1.0, 1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better one of the two cosets of D8."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


@lru_cache(16)
def projection(dims: int, tables: int, seed: int) -> np.ndarray:
    """(tables, BLOCKS, dims, 8): orthonormal directions, scaled so that lengths keep their size on average."""
    rng = np.random.default_rng([seed, dims])
    width = 8 * BLOCKS
    out = []
    for _ in range(tables):
        q, _ = np.linalg.qr(rng.standard_normal((max(dims, width), max(dims, width))))
        out.append(q[:dims, :width].reshape(dims, BLOCKS, 8).transpose(1, 0, 2) * np.sqrt(max(dims, width) / width) / np.sqrt(BLOCKS))
    return np.array(out)


def _mix(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return codes ^ (codes >> np.uint64(29))


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Codes (rows, tables * (1 + probes)) of the cells each unit vector stands in."""
    n, dims = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    r = roots()
    salt = _mix(label.astype(np.int64).view(np.uint64) + np.uint64(dims) * np.uint64(1 << 40))
    weights = np.random.default_rng([seed, 8]).integers(1, 1 << 62, (tables, BLOCKS, 8)).astype(np.uint64) | np.uint64(1)

    def code(points: list[np.ndarray], t: int) -> np.ndarray:
        total = salt + np.uint64(t + 1)
        for k, p in enumerate(points):
            total = total + (((2 * p).astype(np.int64).view(np.uint64)) * weights[t, k]).sum(1, dtype=np.uint64)
        return _mix(_mix(total))

    for t in range(tables):
        points, gains, moves = [], [], []
        for k in range(BLOCKS):
            x = unit @ projection(dims, tables, seed)[t, k] / scale
            p = decode_e8(x)
            points.append(p)
            gain = (x - p) @ r.T
            top = np.argpartition(-gain, probes, axis=1)[:, :probes]
            gains.append(np.take_along_axis(gain, top, 1))
            moves.append(top)
        out[:, t, 0] = code(points, t)
        order = np.argsort(-np.concatenate(gains, axis=1), axis=1, kind="stable")[:, :probes]
        for j in range(probes):
            block, place = order[:, j] // probes, order[:, j] % probes
            moved = [p.copy() for p in points]
            for k in range(BLOCKS):
                here = np.flatnonzero(block == k)
                moved[k][here] += r[moves[k][here, place[here]]]
            out[:, t, 1 + j] = code(moved, t)
    return out.reshape(n, -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _placed(nodes: DataFrame, options: dict) -> DataFrame:
    """(code, node): every cell each node stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            node, label = b.column("node").to_numpy(), b.column("label").to_numpy()
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                for i in range(0, len(at), 1024):
                    part = at[i : i + 1024]
                    rows = flat[starts[part][:, None] + np.arange(dims)]
                    codes = cells(unit_rows(rows), label[part], **options)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes.ravel().view(np.int64)), pa.array(np.repeat(node[part], codes.shape[1]))], names=["code", "node"]
                    )

    return nodes.select("node", F.col("label").cast("long").alias("label"), "embedding").transform(map_batches, run, "code bigint, node bigint").distinct()


def _group_links(vectors: np.ndarray, label: np.ndarray, node: np.ndarray, copies: np.ndarray, block: np.ndarray, code: int, same: bool, threshold: float, options: dict):
    """(node, links counted here, smallest node reached) of the linked nodes of one group."""
    unit = unit_rows(vectors)
    near = unit @ unit.T >= threshold
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    if not same:
        near &= block[:, None] != block[None, :]
    touched = np.flatnonzero(near.any(1))
    if not len(touched):
        return None
    near = near[np.ix_(touched, touched)]
    # A pair counts in the smallest cell it shares: leave out those that also share a smaller one.
    codes = cells(unit[touched], label[touched], **options)
    names, place = np.unique(codes, return_inverse=True)
    less = names < np.array([code], np.int64).view(np.uint64)[0]
    holds = np.zeros((len(touched), len(names)), np.float32)
    holds[np.arange(len(touched))[:, None], place.reshape(codes.shape)] = 1
    holds = holds[:, less & (holds.sum(0) > 1)]
    counted = near & ~(holds @ holds.T > 0) if holds.shape[1] else near
    links = (counted * copies[touched][None, :]).sum(1)
    reach = node[touched]
    while True:
        low = np.minimum(reach, np.where(near, reach[None, :], np.iinfo(np.int64).max).min(1))
        if (low == reach).all():
            break
        reach = low
    return node[touched], links.astype(np.int64), reach


def _compared(groups: DataFrame, threshold: float, options: dict) -> DataFrame:
    """Links inside every (code, low, high) group; rows come sorted by group and a group may span batches."""

    def flush(part: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([part[c].to_numpy() for c in ("code", "low", "high")], axis=1)
        cuts = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1)), [len(keys)]])
        cols = {c: part[c].to_numpy() for c in ("node", "label", "copies", "block")}
        lists = part["embedding"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            sizes = np.diff(offsets[a : b + 1])
            for dims in np.unique(sizes):
                at = a + np.flatnonzero(sizes == dims)
                if len(at) < 2:
                    continue
                rows = flat[offsets[at][:, None] + np.arange(dims)]
                low, high = keys[a, 1], keys[a, 2]
                found = _group_links(rows, *(cols[c][at] for c in ("label", "node", "copies", "block")), keys[a, 0], low == high, threshold, options)
                if found:
                    out.append(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "links", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None and len(held) else t
            if not len(t):
                continue
            keys = np.stack([t[c].to_numpy() for c in ("code", "low", "high")], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from flush(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from flush(held)

    return groups.transform(map_batches, run, "node bigint, links bigint, reach bigint")


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; ``vectors`` has vec_id, embedding and label."""
    options = {"tables": tables, "probes": probes, "scale": scale, "seed": seed}
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = saved(
        vectors.select("vec_id", F.when(valid, F.col("label")).alias("label"), F.when(valid, F.col("embedding")).alias("embedding"))
        .withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding"))),
        "lattice-rows",
    )
    nodes = saved(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").cast("long").alias("label"), F.first("embedding").alias("embedding")),
        "lattice-nodes",
    )
    placed = saved(_placed(nodes, options), "lattice-cells")
    crowded = placed.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
    blocks = placed.join(crowded, "code").select(
        "code", "node", F.pmod(F.xxhash64("node", "code"), spread).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("other")
    )
    groups = (
        blocks.join(nodes.select("node", "copies", "label", "embedding"), "node")
        .select("code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "label", "embedding")
        .repartition("code", "low", "high")
        .sortWithinPartitions("code", "low", "high")
    )
    found = saved(_compared(groups, threshold, options), "lattice-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots_of = components(found.select(F.col("node").alias("u"), F.col("reach").alias("v")), "lattice-components")
    rooted = nodes.select("node", "first_id", "copies").join(roots_of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(names, "root").join(counts, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    done = rows.select("vec_id", "node").join(saved(classes, "lattice-classes"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by brute force; equal as long as the tables find every pair.
OP7_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM good),
pairs AS (SELECT a.vec_id AS u, b.vec_id AS v FROM units a JOIN units b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT p.v, reach.r FROM reach JOIN pairs p ON p.u = reach.u),
roots AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e LEFT JOIN links l ON l.u = e.vec_id LEFT JOIN roots r ON r.u = e.vec_id
"""
