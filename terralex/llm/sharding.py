"""Sharding by histogram sort: exact byte counts below candidate boundaries, then one exchange.

The sort key is the pair (hash of the text, hash of the id), 128 bits wide. Each pass counts the
exact bytes below 4,096 candidate boundaries inside every bin that still holds a wanted splitter,
and narrows to the next 12 bits, until a boundary lies within the tolerance. Equal texts have equal
first hashes, so they stay in one shard unless their group is too large to be placed whole, and then
run over neighbouring shards by their ids.

Nulls: a null text has no bytes and the checksum of the empty text; a null id is hashed like a value.
Rows that are equal in id and text have one key and so one shard. An empty table gives an empty
result. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import saved, text_or_empty

SHARDS = 24
OVERHEAD = 8
TOLERANCE = 0.0005
GROUP_TOLERANCE = 0.01
BITS = 12
PIECE_ROWS = 1 << 14
SIGN = -(1 << 63)


def size_of(text: str | Column = "text") -> Column:
    """Bytes of the text in UTF-8 plus the fixed overhead."""
    return (F.octet_length(text_or_empty(text)) + OVERHEAD).cast("long")


def key_columns(seed: int = 7) -> dict[str, Column]:
    return {"k1": F.xxhash64(text_or_empty()), "k2": F.xxhash64(F.lit(seed), "doc_id", text_or_empty())}


def _digits() -> list[tuple[str, int, int]]:
    """(half, shift, width) of every digit of the key, highest first."""
    out = []
    for half in ("k1", "k2"):
        top = 64
        while top:
            width = min(BITS, top)
            top -= width
            out.append((half, top, width))
    return out


def splitters(keyed: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int]]:
    """``shards`` - 1 keys (signed pairs), in order; a row belongs after every splitter not above its key.

    ``keyed`` has k1, k2 and size. A pass collects at most 4,096 sums for each open splitter.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    # An open splitter: the wanted bytes below, the key's prefix (as an unsigned number) and bytes below that.
    open_ones = {i: (total * i / shards, 0, 0) for i in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    done_bits = 0
    for half, shift, width in _digits():
        if not open_ones:
            break
        value = F.col(half).bitwiseXOR(F.lit(SIGN))
        digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))
        prefixes = sorted({p for _, p, _ in open_ones.values()})
        mark = F.lit(None).cast("int")
        for n, p in enumerate(prefixes):
            mark = F.when(_has_prefix(p, done_bits), F.lit(n)).otherwise(mark)
        counted = (
            keyed.select(mark.alias("mark"), digit.alias("digit"), "size")
            .filter("mark IS NOT NULL")
            .groupBy("mark", "digit")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        bins: dict[int, list] = {}
        for r in counted:
            bins.setdefault(prefixes[r["mark"]], []).append((r["digit"], r["bytes"], r["rows"]))
        done_bits += width
        still = {}
        for i, (want, prefix, below) in open_ones.items():
            at = below
            for d, size, rows in sorted(bins[prefix]):
                if at + size < want:
                    at += size
                    continue
                own = (prefix << width) | d
                low, high = want - at, at + size - want
                allowed = slack if done_bits != 64 else max(slack, group_tolerance * total / shards)
                if min(low, high) <= allowed or rows == 1 or done_bits == 128:
                    found[i] = _boundary(own if low <= high else own + 1, done_bits)
                else:
                    still[i] = (want, own, at)
                break
        open_ones = still
    return [found[i] for i in sorted(found)]


def _has_prefix(prefix: int, bits: int) -> Column:
    """Whether the key's first ``bits`` bits are ``prefix``."""
    if not bits:
        return F.lit(True)
    first = min(bits, 64)
    u1 = F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.lit(SIGN)), 64 - first)
    cond = u1 == F.lit(_signed(prefix >> (bits - first)))
    if bits > 64:
        u2 = F.shiftrightunsigned(F.col("k2").bitwiseXOR(F.lit(SIGN)), 128 - bits)
        cond = cond & (u2 == F.lit(_signed(prefix & ((1 << (bits - 64)) - 1))))
    return cond


def _signed(u: int) -> int:
    return u - (1 << 64) if u >= 1 << 63 else u


def _boundary(prefix: int, bits: int) -> tuple[int, int]:
    """The smallest key with this prefix, in the signed order of the columns."""
    full = min(prefix << (128 - bits), (1 << 128) - 1)
    return (full >> 64) + SIGN, (full & ((1 << 64) - 1)) + SIGN


def assign_shards(
    rows: DataFrame,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    group_tolerance: float = GROUP_TOLERANCE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``rows`` (with k1, k2 and size) plus shard and slot, exchanged once.

    ``counts`` may be a thinner copy of the same keys and sizes, for the counting passes. A shard's
    rows are numbered in pieces of about ``PIECE_ROWS`` rows each, so no task holds a whole shard.
    """
    counts = rows if counts is None else counts
    cuts = splitters(counts.select("k1", "k2", "size"), shards, tolerance, group_tolerance)
    n = counts.count()
    pieces = max(1, -(-n // (PIECE_ROWS * shards)) * 8)

    def placed(df: DataFrame) -> DataFrame:
        shard = F.lit(0)
        for a, b in cuts:
            shard = shard + ((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int")
        return df.withColumns({"shard": shard, "_piece": F.pmod("k2", F.lit(pieces))})

    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed(counts.select("k1", "k2"))
        .groupBy("shard", "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_piece").orderBy("k1", "k2")
    numbered = placed(rows).withColumn("_place", F.row_number().over(inside))
    return numbered.join(offsets, ["shard", "_piece"]).withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long")).drop(
        "_piece", "_place", "_before"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """All columns of ``docs`` with their shard, slot and size: a column of that name in ``docs`` gives way."""
    own = [c for c in docs.columns if c.lower() not in {"shard", "slot", "size"}]
    rows = docs.select("doc_id", "text", F.struct(*own).alias("_row"))
    keyed = rows.withColumns(key_columns()).select("k1", "k2", size_of().alias("size"), "_row")
    counts = saved(keyed.select("k1", "k2", "size"), f"{name}-keys")
    return assign_shards(keyed, shards, counts=counts).select("_row.*", "size", "shard", "slot")


def op3_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = docs.withColumns(key_columns()).select(
        "doc_id", "k1", "k2", size_of().alias("size"), F.crc32(text_or_empty()).cast("long").alias("text_crc32")
    )
    thin = saved(thin, "shard-thin")
    return assign_shards(thin, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


__all__: Sequence[str] = ("assign_shards", "shard_documents", "splitters", "size_of", "op3_shard")
