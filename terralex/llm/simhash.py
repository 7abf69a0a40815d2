"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common point at most half the radius from each,
so if every fingerprint emits all variants within half the radius and the variants are shuffled, the
pair collides. The balls are taken in two steps:

1. Of two halves of 32 bits, one differs in at most half of ``radius`` (2) bits. Every distinct
   fingerprint emits the variants within half of that (1 bit) of each half: 66 rows. Colliding pairs
   are deduplicated (each pair keeps one canonical variant) and verified on all 64 bits.
2. A variant with more than ``CROWD`` fingerprints would make too many pairs. Its fingerprints emit
   their whole 64-bit balls instead, all 2,081 variants within 2 bits. Fingerprints that share such a
   variant are at most 4 bits apart by the triangle inequality, so each needs one link only, to the
   smallest, and no pairs are made. Any link of two of them collides there, so none is lost.

Nulls: a null text is the empty text, with fingerprint zero; documents without words link like any
others. A null id is never a component's name unless all its ids are null. Repeated rows are rows of
their own. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, saved, text_or_empty
from terralex.llm.components import components

WIDTH = 64
HALF = 32
RADIUS = 4
SHINGLE = 4
SEED = 42
CROWD = 64


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, unsigned; ``bytes.split`` cuts at the six ASCII spaces."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, seed)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: len(ends) - shingle]]
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    counts = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.array(hashes[i : i + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).transform(map_batches, run, f"doc_id {kind}, fp bigint")


def _signed(u: int) -> int:
    return u - (1 << 64) if u >= 1 << 63 else u


def _half_variants(distinct: DataFrame) -> DataFrame:
    """(fp, key, flip): the half with at most one bit flipped; ``key`` keeps the other half's bits at zero."""
    low = (1 << HALF) - 1
    flips = [0] + [1 << i for i in range(HALF)]
    masks = [F.struct(F.lit(side).alias("side"), F.lit(_signed(f << (HALF * side))).alias("flip")) for side in (0, 1) for f in flips]
    keep = F.when(F.col("m.side") == 0, F.lit(low)).otherwise(F.lit(_signed(low << HALF)))
    return distinct.select("fp", F.explode(F.array(*masks)).alias("m")).select(
        "fp",
        F.col("m.side").cast("tinyint").alias("side"),
        F.col("fp").bitwiseXOR(F.col("m.flip")).bitwiseAND(keep).alias("key"),
        F.col("m.flip").alias("flip"),
    )


def _ball(crowd: DataFrame, radius: int) -> DataFrame:
    """(fp, key): all variants of all 64 bits within ``radius``."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(WIDTH), n)]
    return crowd.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key")
    )


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) that connect all pairs within ``radius``.

    Pairs of sparse variants all appear; crowded ones are linked to their smallest member only.
    """
    if radius != RADIUS:
        raise ValueError("the halves are laid out for radius 4")
    variants = _half_variants(distinct)
    shared = variants.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes an exploded table to be as small as its source and would broadcast it; merge joins keep it off the driver.
    met = saved(variants.join(shared.hint("merge"), ["side", "key"]), "simhash-met")
    sparse = met.filter(F.col("n") <= crowd)
    a = sparse.select("side", "key", F.col("fp").alias("u"), F.col("flip").alias("fu"))
    b = sparse.select("side", "key", F.col("fp").alias("v"), F.col("flip").alias("fv"))
    # One variant names a pair: the equal half itself, or the one where the smaller fingerprint has the smaller flip.
    canonical = (F.col("u") < F.col("v")) & ((F.col("fu") < F.col("fv")) | ((F.col("fu") == 0) & (F.col("fv") == 0)))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = a.join(b, ["side", "key"]).filter(canonical & near).select("u", "v")
    dense = saved(met.filter(F.col("n") > crowd).select("fp").distinct(), "simhash-dense")
    ball = _ball(dense, radius // 2)
    least = ball.groupBy("key").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).filter("u < top").select("key", "u")
    stars = ball.join(least.hint("merge"), "key").filter("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars)


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of ``docs``."""
    prints = saved(fingerprints(docs), "simhash-prints")
    firsts = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    roots = components(fingerprint_links(firsts.select("fp"), radius), "simhash-links")
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = saved(rooted.join(names, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest id.

    Of rows with that very id each different text stays once; repeats go by a row number.
    Rows without an id stay.
    """
    from pyspark.sql import Window

    kept = near_groups(docs.select("doc_id", "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"))
    chosen = rows.join(kept, F.col("_row.doc_id") == F.col("_id"))
    repeats = Window.partitionBy("_id", "_row.text").orderBy(F.xxhash64("_row.text"))
    once = chosen.withColumn("_n", F.row_number().over(repeats)).filter("_n = 1").select("_row.*")
    return once.unionByName(docs.filter("doc_id IS NULL"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
