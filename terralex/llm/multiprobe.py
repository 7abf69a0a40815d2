"""Nearest neighbours by largest inner product: multiprobe p-stable hashing, then exact reranking.

Rows are brought onto a sphere: a row x becomes (x / M, sqrt(1 - |x|^2 / M^2)), M the largest length, and a
query q becomes (q / |q|, 0). Distances there order rows as inner products do. A table has a few functions
floor((a.v - m) / (w r) + b) with Gaussian, so 2-stable, a; the outer cells are open, three a function.

A query knows its own projections, so how a neighbour's would fall is a normal law: with g the inner
product above the mean that a neighbour is expected to have and h its last coordinate, it lies around the
mean row's projection plus g (a.q) + h a', a' the last part of a, and what is left of its unit length is the
variance. The product of its functions' chances is a bucket's estimated success. Buckets are visited in
falling order of it until they hold the success a table needs for all tables together to reach ``SUCCESS``,
so hard queries visit many buckets and easy ones few, and there is no cap on buckets, candidates or rows.

``g`` comes from the query's inner products with a sample of ``SAMPLE_ROWS`` rows: their median and spread
carried to the k-th largest of n under a normal law, lowered where the sample's own tail falls short of
that law; ``h`` from the sample's best rows. Centres m and radius r come from the sample too. Every row is
indexed, in every table.

Shuffle: leading functions name a group of about ``GROUP_NUMBERS`` vector components. A row goes to one
group of each table, a query to the groups it visits, once each with the list of its buckets there. Groups
above that size are split into shards, and queries meet every shard, so crowded buckets stay exact. A
shard's rows are in memory, sorted by bucket; queries stream past, and a bucket meets its queries as one
matrix product. A task emits k + 1 rows a query. Of equal vectors only the k + 1 smallest ids can be
among anyone's first k, so only these are indexed; equal queries are searched once.

Scores are inner products of the original vectors in extended precision, rounded once to double.

Nulls: rows with a null id or vector, zero vectors and those with null or non-finite components take no part.
Vectors meet only vectors of their length. Rows repeated count as rows of their own; a query leaves out
itself only. Ties go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, saved
from terralex.llm.vector_blocks import Best, by_length, finite, key_runs

NEAREST = 20
TABLES = 3
CELLS = 3
WIDTH = 1.2
BUCKET_ROWS = 64
MOST_FUNCTIONS = 8
SUCCESS = 0.97
SAMPLE_ROWS = 2048
GROUP_NUMBERS = 1 << 21
SEED = 1212
#: Queries that meet a shard at once.
QUERY_ROWS = 512

_normal = np.frompyfunc(lambda x: 0.5 * (1.0 + math.erf(x / math.sqrt(2.0))), 1, 1)


def normal_tail(p: float) -> float:
    """Where a standard normal leaves ``p`` above itself; 0 for a half or more."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(1.0 - p) if 0.0 < p < 0.5 else 0.0


@dataclass(frozen=True)
class Space:
    """What is known of the vectors of one length: their number, largest norm and a sample."""

    dims: int
    rows: int
    norm: float
    sample: np.ndarray
    tables: int
    k: int
    seed: int

    @property
    def functions(self) -> int:
        if len(self.sample) < 32:
            return 0
        return int(np.clip(round(math.log(self.rows / BUCKET_ROWS, CELLS)) if self.rows > BUCKET_ROWS else 0, 0, MOST_FUNCTIONS))

    @property
    def leading(self) -> int:
        """Functions that name a group."""
        groups = self.rows * self.dims / GROUP_NUMBERS
        return int(np.clip(math.ceil(math.log(groups, CELLS)) if groups > 1 else 0, 0, self.functions))

    @property
    def shard_rows(self) -> int:
        return max(1024, GROUP_NUMBERS // max(self.dims, 1))

    def on_sphere(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    @property
    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        return _directions(self.dims, self.tables, self.functions, self.seed)


@lru_cache(16)
def _directions(dims: int, tables: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dims])
    return rng.standard_normal((dims + 1, tables, functions)), rng.uniform(0, 1, (tables, functions))


class Index:
    """Bucket numbers of rows and the buckets a query visits."""

    def __init__(self, space: Space):
        self.space = space
        self.seen = space.on_sphere(space.sample)
        a, self.b = space.directions
        self.a = a
        if space.functions:
            self.mean = np.tensordot(self.seen, a, 1).mean(0)
            self.centre = self.seen.mean(0)
            self.radius = math.sqrt(max((self.seen**2).sum(1).mean() - self.centre @ self.centre, 1e-12))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers."""
        s = self.space
        out = np.zeros((len(x), s.tables), np.int64)
        if s.functions:
            place = (np.tensordot(s.on_sphere(x), self.a, 1) - self.mean) / (WIDTH * self.radius) + self.b
            cell = np.clip(np.floor(place).astype(np.int64) + 1, 0, CELLS - 1)
            for f in range(s.functions):
                out = out * CELLS + cell[:, :, f]
        return out

    def expected(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its k-th neighbour's expected inner product above the mean, and last coordinate."""
        seen = unit @ self.seen[:, :-1].T
        middle = np.median(seen, axis=1)
        spread = 1.4826 * np.median(np.abs(seen - middle[:, None]), axis=1)
        k, n, m = self.space.k, self.space.rows, seen.shape[1]
        here = normal_tail(k / m)
        top = np.sort(seen, axis=1)[:, max(0, m - k)] - middle
        shorter = np.minimum(1.0, top / np.maximum(spread * here, 1e-12)) if here else np.ones(len(unit))
        best = np.argsort(-seen, axis=1)[:, : max(8, math.ceil(k * m / n))]
        gain = middle + shorter * spread * normal_tail(k / n) - unit @ self.centre[:-1]
        return np.maximum(0.0, gain), self.seen[best, -1].mean(1)

    def visits(self, q: np.ndarray) -> list[list[np.ndarray]]:
        """For each query and table the bucket numbers to visit, best first."""
        s = self.space
        if not s.functions:
            return [[np.zeros(1, np.int64)] for _ in range(len(q))] if s.tables == 1 else [[np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * (s.tables - 1) for _ in q]
        unit = q / np.sqrt((q * q).sum(1, keepdims=True))
        gain, last = self.expected(unit)
        room = np.maximum(1.0 - last**2 - self.centre[:-1] @ self.centre[:-1], 1e-9)
        gain = np.minimum(gain, 0.999 * np.sqrt(room))
        spread = np.sqrt(room - gain**2)
        own = np.tensordot(unit, self.a[:-1], 1)
        shift = gain[:, None, None] * own + (last - self.centre[-1])[:, None, None] * self.a[-1]
        need = 1.0 - (1.0 - SUCCESS) ** (1.0 / s.tables)
        out: list[list[np.ndarray]] = [[] for _ in q]
        for t in range(s.tables):
            chance = np.ones((len(q), 1))
            for f in range(s.functions):
                low = -self.b[t, f] * WIDTH * self.radius
                ends = np.array([-np.inf, low, low + WIDTH * self.radius, np.inf])
                z = (ends[None, :] - shift[:, t, f][:, None]) / spread[:, None]
                each = np.diff(_normal(z).astype(float), axis=1)
                chance = (chance[:, :, None] * each[:, None, :]).reshape(len(q), -1)
            order = np.argsort(-chance, axis=1, kind="stable")
            held = np.cumsum(np.take_along_axis(chance, order, 1), axis=1)
            enough = (held < need).sum(1) + 1
            for i, n in enumerate(enough):
                out[i].append(order[i, :n])
        return out


def fit(rows: DataFrame, tables: int = TABLES, k: int = NEAREST, seed: int = SEED) -> dict[int, Space]:
    """One ``Space`` per vector length, from one aggregation and a sample of at most ``SAMPLE_ROWS`` rows.

    Lengths too rare to be in the sample get one bucket, so they are compared in full.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("norm")).collect()
    picked = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("embedding").collect()
    sample: dict[int, list] = {}
    for r in picked:
        sample.setdefault(len(r[0]), []).append(r[0])
    return {
        r["dims"]: Space(r["dims"], r["n"], r["norm"], np.array(sample.get(r["dims"], np.empty((0, r["dims"]))), float), tables, k, seed) for r in sizes
    }


_PLACE = "dims int, tab int, grp bigint"


def _placed(rows: DataFrame, spaces: dict[int, Space], with_vectors: bool) -> DataFrame:
    """Every row once per table: its group, bucket and, if asked for, what the search needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {d: Index(s) for d, s in spaces.items()}
        for b in batches:
            for dims, at, x in by_length(b.column("embedding")):
                s = spaces[dims]
                used = s.tables if s.functions else 1
                codes = index[dims].codes(x)[:, :used]
                tab = np.tile(np.arange(used, dtype=np.int32), (len(at), 1))
                cols = {"dims": np.full(codes.size, dims, np.int32), "tab": tab.ravel(), "grp": (codes // CELLS ** (s.functions - s.leading)).ravel()}
                if with_vectors:
                    again = pa.array(np.repeat(at, used))
                    cols |= {"code": codes.ravel(), "row": b.column("row").take(again), "vec_id": b.column("vec_id").take(again), "embedding": b.column("embedding").take(again)}
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols))

    kind = dict(rows.dtypes)["embedding"]
    extra = f", code bigint, row bigint, vec_id bigint, embedding {kind}" if with_vectors else ""
    return rows.select("row", "vec_id", "embedding").transform(map_batches, run, _PLACE + extra)


def _visiting(queries: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """Every query once per group it visits, with its buckets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {d: Index(s) for d, s in spaces.items()}
        for b in batches:
            for dims, at, x in by_length(b.column("embedding")):
                s = spaces[dims]
                split = CELLS ** (s.functions - s.leading)
                for lo in range(0, len(at), 128):
                    cols: dict[str, list] = {c: [] for c in ("tab", "grp", "codes", "place")}
                    for i, tables in enumerate(index[dims].visits(x[lo : lo + 128])):
                        for t, codes in enumerate(tables):
                            groups = codes // split
                            order = np.argsort(groups, kind="stable")
                            names, first = np.unique(groups[order], return_index=True)
                            for g, part in zip(names, np.split(codes[order], first[1:])):
                                for c, v in (("tab", t), ("grp", int(g)), ("codes", part), ("place", int(at[lo + i]))):
                                    cols[c].append(v)
                    again = pa.array(cols["place"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims] * len(again), pa.int32()), pa.array(cols["tab"], pa.int32()), pa.array(cols["grp"], pa.int64()),
                         pa.array(cols["codes"], pa.list_(pa.int64())), b.column("row").take(again), b.column("embedding").take(again)],
                        names=["dims", "tab", "grp", "codes", "row", "embedding"],
                    )

    kind = dict(queries.dtypes)["embedding"]
    return queries.select("row", "embedding").transform(map_batches, run, _PLACE + f", codes array<bigint>, row bigint, embedding {kind}")


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, summed in extended precision and rounded once."""
    return (a.astype(np.longdouble) * b.astype(np.longdouble)).sum(1).astype(np.float64)


class _Shard:
    """The rows of one shard, sorted by bucket."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        code = t["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        ((_, at, vectors),) = by_length(t["embedding"].combine_chunks())
        self.vectors = vectors[order]
        self.row, self.vec_id = t["row"].to_numpy()[order], t["vec_id"].to_numpy()[order]
        self.names, first = np.unique(code[order], return_index=True)
        self.ends = np.concatenate([first, [len(code)]])

    def nearest(self, q: np.ndarray, codes: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
        """(query, score, vec_id, row) of the best k rows of each query among its buckets."""
        who = np.repeat(np.arange(len(q)), [len(c) for c in codes])
        flat = np.concatenate(codes)
        place = np.searchsorted(self.names, flat)
        there = (place < len(self.names)) & (self.names[np.minimum(place, len(self.names) - 1)] == flat)
        who, place = who[there], place[there]
        order = np.argsort(place, kind="stable")
        who, place = who[order], place[order]
        best = Best(len(q), k, np.float64)
        # Rounding in a block's products depends on its shape; what is this close to a limit is scored exactly.
        slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((self.vectors * self.vectors).sum(1).max(initial=0.0)) * q.shape[1]
        buckets, first = np.unique(place, return_index=True)
        for p, here in zip(buckets, np.split(who, first[1:])):
            for lo in range(self.ends[p], self.ends[p + 1], 1024):
                hi = min(lo + 1024, self.ends[p + 1])
                rough = q[here] @ self.vectors[lo:hi].T
                g, r = np.nonzero(rough >= (best.limit[here] - slack[here])[:, None])
                for i in range(0, len(g), 1 << 15):
                    a, b = here[g[i : i + (1 << 15)]], lo + r[i : i + (1 << 15)]
                    best.offer(a, exact_products(q[a], self.vectors[b]), self.vec_id[b], self.row[b])
        return best.entries()


def _searched(met: DataFrame, k: int) -> DataFrame:
    """The best k rows of every query in each shard it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for (*place, kind), b in key_runs(batches, ["dims", "tab", "grp", "shard", "kind"]):
            if place != now:
                now, parts, shard = place, [], None
            if kind == 0:
                parts.append(b)
                continue
            if parts:
                shard, parts = _Shard(parts), []
            if shard is None:
                continue
            for lo in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(lo, QUERY_ROWS)
                ((_, _, q),) = by_length(part.column("embedding"))
                lists = part.column("codes")
                codes = np.split(lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
                who, score, ids, rows = shard.nearest(q, codes, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("row").to_numpy()[who]), pa.array(rows), pa.array(ids), pa.array(score)], names=["query", "row", "vec_id", "score"]
                )

    return met.transform(map_batches, run, "query bigint, row bigint, vec_id bigint, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEAREST, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """query (its row), rank, row, vec_id and score of the k rows nearest to each query.

    ``rows`` and ``queries`` have row, vec_id and embedding as ``search_rows`` gives them; a query that is a
    row itself is not its own neighbour.
    """
    spaces = fit(rows, tables, k, seed)
    kind = dict(rows.dtypes)["embedding"]
    copies = Window.partitionBy("_h", "embedding").orderBy("vec_id", "row")
    indexed = (
        rows.withColumn("_h", F.xxhash64("embedding")).withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).select("row", "vec_id", "embedding")
    )
    indexed = saved(indexed, "probe-rows")
    sizes = saved(_placed(indexed, spaces, False).groupBy("dims", "tab", "grp").agg(F.count(F.lit(1)).alias("n")), "probe-groups")
    per_shard = F.greatest(F.lit(1024), F.floor(F.lit(GROUP_NUMBERS) / F.greatest("dims", F.lit(1))))
    shards = sizes.select("dims", "tab", "grp", F.ceil(F.col("n") / per_shard).cast("int").alias("shards"))
    place = ["dims", "tab", "grp"]
    resident = _placed(indexed, spaces, True).join(shards, place).select(
        *place, F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "code",
        F.lit(None).cast("array<bigint>").alias("codes"), "row", "vec_id", "embedding",
    )
    members = saved(queries.withColumn("_h", F.xxhash64("embedding")).select("row", "_h", "embedding"), "probe-members")
    asked = saved(members.groupBy("_h", "embedding").agg(F.min("row").alias("query")), "probe-queries")
    visiting = _visiting(asked.select(F.col("query").alias("row"), "embedding"), spaces).join(shards, place).select(
        *place, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("code"),
        "codes", "row", F.lit(None).cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"),
    )
    met = resident.unionByName(visiting).repartition(*place, "shard").sortWithinPartitions(*place, "shard", "kind")
    found = _searched(met, k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    merged = found.withColumn("_d", F.dense_rank().over(order)).filter(F.col("_d") <= k + 1).drop("_d").dropDuplicates(["query", "row"])
    whose = members.join(asked, ["_h", "embedding"]).select(F.col("row").alias("own"), "query")
    own = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row")
    return (
        whose.join(saved(merged, "probe-found"), "query").filter("own <> row")
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select(F.col("own").alias("query"), "rank", "row", "vec_id", "score")
    )


def search_rows(vectors: DataFrame) -> DataFrame:
    """row, vec_id and embedding of the rows that take part, written once."""
    fine = F.col("vec_id").isNotNull() & finite("embedding") & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    return saved(vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "search-rows")


def op12_nearest(spark, sf_dir: str) -> DataFrame:
    rows = search_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = rows.filter(F.col("vec_id") % 20 == 0)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").cast("long").alias("query_id"))
    return nearest(rows, queries).join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), "score")
