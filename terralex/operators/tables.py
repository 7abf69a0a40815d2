"""Keyed joins, first-per-key, cache filling and other whole-table steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from terralex.functions.scalars import key_normalize


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if len(order) == 1:
        # Plain columns keep the aggregate hashed.
        picks = [F.min(c).alias(c) if c == order[0] else F.min_by(c, order[0]).alias(c) for c in rest]
        return df.groupBy(*keys).agg(*picks).select(*df.columns)
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, "_r.*").select(*df.columns)


def rounded_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Left join after bringing both sides' keys to one form; with ``order`` the right is deduplicated."""
    r = key_normalize(right, keys)
    if order:
        r = dedup_keep_first(r, keys, order)
    return key_normalize(left, keys).join(r, list(keys), "left")


def enrich_join(df: DataFrame, env: DataFrame, geo: DataFrame, env_order: Sequence[str], geo_order: Sequence[str]) -> DataFrame:
    """Dated features by (lat, lon, day), then fixed features by coordinate at 4 places."""
    dated = df.join(dedup_keep_first(env, ["lat", "lon", "day"], env_order), ["lat", "lon", "day"], "left")
    fixed = geo.withColumns({"_klat": F.bround("lat", 4), "_klon": F.bround("lon", 4)}).drop("lat", "lon")
    fixed = dedup_keep_first(fixed, ["_klat", "_klon"], geo_order)
    keyed = dated.withColumns({"_klat": F.bround("lat", 4), "_klon": F.bround("lon", 4)})
    return keyed.join(fixed, ["_klat", "_klon"], "left").drop("_klat", "_klon")


def column_order_repair(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The expected columns in their order when all are present; otherwise the frame as it is."""
    return df.select(*expected) if set(expected) <= set(df.columns) else df


def incremental_fill(
    df: DataFrame,
    cache: DataFrame | None,
    keys: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
    required: Sequence[str],
) -> DataFrame:
    """The cache extended by the keys of ``df`` it does not hold yet; only those are computed.

    A cache without the required columns is computed anew. A key the cache holds twice keeps one row.
    """
    wanted = df.select(*keys).distinct()
    if cache is None or not set(required) <= set(cache.columns):
        return compute(wanted)
    missing = wanted.join(cache.select(*keys), list(keys), "left_anti")
    kept = dedup_keep_first(cache, keys, [c for c in cache.columns if c not in keys])
    return kept.unionByName(compute(missing), allowMissingColumns=True)


def fill_cache(
    df: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], required: Sequence[str]
) -> DataFrame:
    """``incremental_fill`` against the Parquet table at ``path``: new rows are appended there, and the table returned.

    A table there without the required columns is an error.
    """
    spark = df.sparkSession
    try:
        cache = spark.read.parquet(path)
    except AnalysisException:
        cache = None
    wanted = df.select(*keys).distinct()
    if cache is not None and not set(required) <= set(cache.columns):
        raise ValueError(f"the table at {path} lacks {sorted(set(required) - set(cache.columns))}; name a new path")
    missing = wanted if cache is None else wanted.join(cache.select(*keys), list(keys), "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def distinct_locations(df: DataFrame) -> DataFrame:
    return df.select("lat", "lon").distinct()


def key_set_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def key_set_difference(a: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(existing.select(*keys), list(keys), "left_anti")


def first_nonblank_record(df: DataFrame, group: str, order: str, col: str) -> DataFrame:
    """Per group the first record whose column is not blank, else the first record."""
    blank = (F.coalesce(F.trim(col), F.lit("")) == "").cast("int")
    rest = [c for c in df.columns if c != group]
    pick = F.min_by(F.struct(*rest), F.struct(blank.alias("b"), F.col(order).alias("o"))).alias("_r")
    return df.groupBy(group).agg(pick).select(group, "_r.*")


LAYER_SCHEMA = (
    "properties struct<layers:array<struct<name:string,depths:array<struct<values:struct<mean:double>>>>>>"
)
# Layer name -> divisor.
LAYER_DIVISORS = {"phh2o": 10.0}


def nested_json_layers(df: DataFrame, id_col: str, json_col: str, names: Sequence[str]) -> DataFrame:
    """First depth's mean of each named layer of a JSON reply, as ``soil_<name>`` columns."""
    layers = F.from_json(json_col, LAYER_SCHEMA)["properties"]["layers"]
    out = df.select(id_col, layers.alias("_l"))

    def value(name: str) -> Column:
        found = F.filter("_l", lambda x: x["name"] == name)
        mean = F.get(F.get(found, F.lit(0))["depths"], F.lit(0))["values"]["mean"]
        return (mean / F.lit(LAYER_DIVISORS.get(name, 1.0))).alias(f"soil_{name}")

    return out.select(id_col, *[value(n) for n in names])


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population spread, a flat column by 1; one aggregate, read as a scalar."""
    from terralex.operators.quantiles import global_row

    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    st = F.col("_st")
    scaled = {c: (F.col(c) - st[f"m_{c}"]) / F.when(st[f"s_{c}"] == 0, F.lit(1.0)).otherwise(st[f"s_{c}"]) for c in cols}
    return df.withColumn("_st", global_row(stats)).withColumns(scaled).drop("_st")


def polynomial_terms(cols: Sequence[str]) -> dict[str, Column]:
    """Degree-2 products of columns, each pair once and each square."""
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]}


def polynomial_allowed(n_rows: Column, n_features: int, n_aux: int) -> Column:
    """Whether there are rows enough for the quadratic terms."""
    return (n_rows > 3 * (n_features * (n_features + 1) // 2)) & F.lit(n_aux >= 2)


def polynomial_expand(df: DataFrame, cols: Sequence[str], n_aux: int | None = None) -> DataFrame:
    """Standardised columns and, where the rows allow it, their quadratic terms (else null)."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    allowed = polynomial_allowed(F.col("_n"), len(cols), len(cols) if n_aux is None else n_aux)
    scaled = standard_scale(df, cols).withColumn("_n", n)
    return scaled.withColumns({k: F.when(allowed, v) for k, v in polynomial_terms(cols).items()}).drop("_n")


def station_weights(df: DataFrame, test_stations: DataFrame, test_weight: float = 4.0, base_weight: float = 1.0) -> DataFrame:
    marked = test_stations.select("station").distinct().withColumn("_t", F.lit(True))
    weight = F.when(F.col("_t"), F.lit(test_weight)).otherwise(F.lit(base_weight))
    return df.join(marked, "station", "left").withColumn("weight", weight).drop("_t")
