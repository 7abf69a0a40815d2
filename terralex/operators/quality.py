"""Data-quality tables: missingness, distributions, dependence, coverage in space and time."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.functions.scalars import pearson
from terralex.operators.quantiles import exact_quantiles, global_row, medians_wide, melt, ranked_tally, value_ranks
from terralex.operators.scan import running_sum
from terralex.operators.space_tree import nearest_pairs
from terralex.session import cut_lineage


def missing_profile(df: DataFrame, cols: Sequence[str], sparse: float = 0.95) -> DataFrame:
    """Per column the missing count and share, and whether it is all missing or too sparse."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"))
    flags = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit(0)).alias("m")) for c in cols])
    share = F.col("n_missing") / F.col("_n")
    return (
        one.select("_n", F.explode(flags).alias("_f"))
        .select(F.col("_f.col").alias("col"), F.col("_f.m").alias("n_missing"), "_n")
        .select(
            "col", "n_missing", F.when(F.col("_n") > 0, share).alias("missing_share"),
            (F.col("n_missing") == F.col("_n")).alias("all_missing"), (share > sparse).alias("too_sparse"),
        )
    )


def missing_total(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    gone = sum((F.col(c).isNull().cast("bigint") for c in cols[1:]), F.col(cols[0]).isNull().cast("bigint"))
    return df.agg(F.sum(gone).alias("n_missing"), (F.sum(gone) / (F.count(F.lit(1)) * len(cols))).alias("missing_share"))


def coverage_by_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return missing_profile(df, cols).select("col", (1.0 - F.col("missing_share")).alias("coverage"))


def describe_targets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, spread, min, exact quartiles, max per column."""
    long = melt(df, [], cols).filter(F.col("value").isNotNull())
    base = long.groupBy("col").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return base.join(exact_quantiles(long, ["col"], "value", [0.25, 0.5, 0.75], ["q25", "median", "q75"]), "col")


def count_locations(df: DataFrame, places: int = 3) -> DataFrame:
    return df.select(F.bround("lat", places).alias("lat"), F.bround("lon", places).alias("lon")).distinct().agg(
        F.count(F.lit(1)).alias("n_locations")
    )


def skew_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-adjusted skewness (needs 3 values), median and count."""
    long = melt(df, [], cols).filter(F.col("value").isNotNull())
    n = F.count("value").cast("double")
    adjusted = F.when(n > 2, F.skewness("value") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    base = long.groupBy("col").agg(adjusted.alias("skew"), F.count("value").alias("n"))
    return base.join(exact_quantiles(long, ["col"], "value", [0.5], ["median"]), "col")


# Coefficients of Acklam's rational approximation to the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile_sql(p: str) -> str:
    """The standard normal quantile of a probability, as an expression any SQL engine takes."""

    def poly(coefs: Sequence[float], x: str) -> str:
        out = repr(float(coefs[0]))
        for c in coefs[1:]:
            out = f"({out} * {x} + {float(c)!r})"
        return out

    def tail(x: str) -> str:
        return f"({poly(_C, x)} / ({poly(_D, x)} * {x} + 1e0))"

    centre = f"(({p}) - 5e-1)"
    square = f"({centre} * {centre})"
    mid = f"({poly(_A, square)} * {centre} / ({poly(_B, square)} * {square} + 1e0))"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - ({p})))"
    return f"(CASE WHEN ({p}) < 2.425e-2 THEN {tail(low)} WHEN ({p}) > 9.7575e-1 THEN -{tail(high)} ELSE {mid} END)"


def normal_qq(df: DataFrame, col: str, chunk: int = 10_000) -> DataFrame:
    """Ordered values against normal quantiles at Filliben's medians: (theoretical, ordered).

    A value held by many rows is expanded chunk by chunk after a shuffle, so no task writes all.
    """
    ranks = value_ranks(df, [], col)
    chunks = ranks.select(
        col, "before", "n", "n_equal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_equal") - 1) / chunk))).alias("_k")
    ).repartition("_k", col)
    last = F.least((F.col("_k") + 1) * chunk, F.col("n_equal"))
    rows = chunks.select(col, "n", "before", F.explode(F.sequence(F.col("_k") * chunk + 1, last)).alias("_i"))
    rows = rows.select(col, "n", (F.col("before") + F.col("_i")).alias("i"))
    edge = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    place = F.when(F.col("i") == F.col("n"), edge).when(F.col("i") == 1, 1.0 - edge).otherwise(
        (F.col("i") - 0.3175) / (F.col("n") + 0.365)
    )
    return rows.withColumn("_p", place).select(
        F.expr(normal_quantile_sql("_p")).alias("theoretical"), F.col(col).alias("ordered")
    )


def qq_line(qq: DataFrame) -> DataFrame:
    return qq.agg(
        F.regr_slope("ordered", "theoretical").alias("slope"), F.regr_intercept("ordered", "theoretical").alias("intercept"),
        pearson("ordered", "theoretical").alias("r"), F.count(F.lit(1)).alias("n"),
    )


def _null_classes(rows: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """A number per column; columns with one number are missing in the same rows.

    Sums of hashed null patterns propose the classes, and a count of differing rows confirms them.
    """
    gone = lambda c: F.col(c).isNull().cast("int")
    pattern = F.xxhash64(*[gone(c) for c in cols]).cast("decimal(38,0)")
    found = rows.agg(*[F.struct(F.sum(gone(c)), F.sum(F.when(F.col(c).isNull(), pattern))).alias(c) for c in cols]).first()
    first: dict[tuple, str] = {}
    head = {c: first.setdefault(tuple(found[c]), c) for c in cols}
    others = [c for c in cols if head[c] != c]
    if others:
        off = rows.agg(*[F.sum((gone(c) != gone(head[c])).cast("int")).alias(c) for c in others]).first()
        head |= {c: c for c in others if off[c]}
    number = {h: i for i, h in enumerate(dict.fromkeys(head.values()))}
    return {c: number[head[c]] for c in cols}


#: Columns up to which products are summed by SQL aggregates instead of matrices.
NARROW = 10


def _summed_products(vectors: DataFrame, widest: int) -> DataFrame:
    """(m, s): per ``m`` the flat matrix of products of its vectors' entries, row by row, then the number of vectors."""
    if widest <= NARROW:
        entry = [F.sum(F.get("r", F.lit(i)) * F.get("r", F.lit(j))) for i in range(widest) for j in range(i, widest)]
        upper = {p: k for k, p in enumerate((i, j) for i in range(widest) for j in range(i, widest))}
        sums = vectors.groupBy("m").agg(*[e.alias(f"e{k}") for k, e in enumerate(entry)], F.count(F.lit(1)).cast("double").alias("n"), F.max(F.size("r")).alias("p"))
        flat = [F.col(f"e{upper[min(i, j), max(i, j)]}") for i in range(widest) for j in range(widest)]
        return sums.select("m", F.concat(F.filter(F.array(*flat), lambda v: v.isNotNull()), F.array_repeat("n", F.col("p"))).alias("s"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, r in batch.groupby("m")["r"]:
                x = np.stack(r.to_numpy())
                sums[m] = sums.get(m, 0.0) + np.concatenate([x.T @ x, np.full((1, x.shape[1]), float(len(x)))])
        for m, s in sums.items():
            yield pd.DataFrame({"m": m, "at": np.arange(s.size), "s": s.ravel()})

    products = vectors.select("m", "r").mapInPandas(multiply, "m int, at int, s double").groupBy("m", "at").agg(F.sum("s").alias("s"))
    return products.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("at", "s")))["s"].alias("s"))


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], min_rows: int = 10) -> DataFrame:
    """Spearman correlation of column pairs over rows where both are present; 0 below the minimum.

    Ranks depend on the partner only through the rows it is missing in. So a column is ranked once for
    each class of columns that are missing in the same rows: a row is copied once per column and class,
    not once per pair. A row's ranks come together as one vector, and the vectors' products are summed as
    matrices. Ranks have mean (n+1)/2, so centred products give the correlation.
    """
    pairs = list(pairs)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    spark = df.sparkSession
    asked = spark.createDataFrame(pairs, "a string, b string")
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))
    named = _null_classes(rows, [f"c{i}" for i in range(len(cols))])
    part = [named[f"c{i}"] for i in range(len(cols))]
    place = {c: i for i, c in enumerate(cols)}
    # A meeting is a pair of classes; its members are the columns of both that are asked for there.
    members: dict[tuple[int, int], set[int]] = {}
    for a, b in pairs:
        i, j = place[a], place[b]
        members.setdefault((min(part[i], part[j]), max(part[i], part[j])), set()).update((i, j))
    meetings = [(k, sorted(v)) for k, v in sorted(members.items())]
    groups = []
    for m, (_, held) in enumerate(meetings):
        present = functools.reduce(lambda x, y: x & y, [F.col(f"c{i}").isNotNull() for i in held])
        entries = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col(f"c{i}").alias("v")) for k, i in enumerate(held)])
        groups.append(F.when(present, entries).otherwise(F.array().cast("array<struct<m:int,k:int,v:double>>")))
    long = rows.select("_row", F.explode(F.concat(*groups)).alias("_e")).select("_row", "_e.*")
    ranks = ranked_tally(long.groupBy("m", "k", "v").agg(F.count(F.lit(1)).alias("c")), ["m", "k"], "v", "c")
    centred = (F.col("before") + (F.col("c") + 1) / 2.0) - (F.col("n") + 1) / 2.0
    ranked = long.join(ranks.select("m", "k", "v", centred.alias("r")), ["m", "k", "v"])
    vectors = ranked.groupBy("_row", "m").agg(F.sort_array(F.collect_list(F.struct("k", "r")))["r"].alias("r"))

    matrix = _summed_products(vectors, max((len(h) for _, h in meetings), default=1))
    where = []
    for a, b in pairs:
        i, j = place[a], place[b]
        m, held = next((m, held) for m, (k, held) in enumerate(meetings) if k == (min(part[i], part[j]), max(part[i], part[j])))
        where.append((a, b, m, held.index(i), held.index(j), len(held)))
    at = lambda i, j: F.get("s", F.col(i) * F.col("p") + F.col(j))
    placed = spark.createDataFrame(where, "a string, b string, m int, i int, j int, p int").join(matrix, "m")
    sums = placed.select("a", "b", at("i", "j").alias("xy"), at("i", "i").alias("xx"), at("j", "j").alias("yy"), at("p", "i").alias("n"))
    rho = F.when((F.col("n") >= min_rows) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    found = sums.select("a", "b", F.coalesce(rho, F.lit(0.0)).alias("rho"), F.col("n").cast("long").alias("n"))
    return asked.join(found, ["a", "b"], "left").na.fill({"rho": 0.0, "n": 0})


def spearman_matrix(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(feature, target, rho, mean_abs_rho) for every feature and target."""
    rho = spearman_pairs(df, list(itertools.product(features, targets)))
    mean = rho.groupBy("a").agg((F.sum(F.abs("rho")) / F.lit(len(targets))).alias("mean_abs_rho"))
    return rho.join(mean, "a").select(F.col("a").alias("feature"), F.col("b").alias("target"), "rho", "mean_abs_rho")


def collinear_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Feature pairs whose |rho| reaches the threshold."""
    rho = spearman_pairs(df, list(itertools.combinations(features, 2)), min_rows=2)
    return rho.filter(F.abs("rho") >= threshold).select(F.col("a").alias("feature_1"), F.col("b").alias("feature_2"), "rho")


def _filled_pairs(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(a, b, x, y): every feature and target of every row, missing features at the column median, rows without the target left out."""
    med = global_row(medians_wide(df, [], features))
    filled = df.withColumn("_m", med).withColumns({f: F.coalesce(F.col(f).cast("double"), F.col("_m")[f]) for f in features})
    pairs = list(itertools.product(features, targets))
    packed = F.array(
        *[F.struct(F.lit(f).alias("a"), F.lit(t).alias("b"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f, t in pairs]
    )
    return filled.select(F.explode(F.filter(packed, lambda p: p["x"].isNotNull() & p["y"].isNotNull())).alias("_p")).select("_p.*")


def digamma(n: Column) -> Column:
    """The digamma function of numbers from 1 up: six steps up, then its asymptotic series."""
    x = n.cast("double") + 6.0
    q = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - q * (1.0 / 12 - q * (1.0 / 120 - q * (1.0 / 252 - q * (1.0 / 240 - q / 132))))
    return series - functools.reduce(lambda a, b: a + b, [1.0 / (n.cast("double") + i) for i in range(6)])


#: Steps a spread is cut into, so that distances are whole numbers and compare exactly.
SPREAD_STEPS = float(1 << 30)


def mutual_information(df: DataFrame, features: Sequence[str], targets: Sequence[str], neighbors: int = 5) -> DataFrame:
    """Mutual information (nats) from nearest neighbours: (feature, target, mi), 0 at least.

    Both values are divided by their spread. A row's distance to its k-th neighbour, in the larger of both
    differences, is its radius; how many rows lie nearer than that in one value alone, itself included,
    tells how much the other value narrows it down: mi = psi(n) + psi(k) - mean psi(n_x) - mean psi(n_y).
    Equal rows are neighbours at distance 0; a radius of 0 counts the equal values. Values are whole numbers of
    2^-30 of a spread, so that rows on a grid tie as they should.

    Neighbours come from an adaptive tree, and counts from running sums over sorted values, in segments.
    Missing features take the column median, rows without the target are left out; fewer than k + 1 rows
    give 0.
    """
    key, spot = ["a", "b"], ["x", "y"]
    pairs = cut_lineage(_filled_pairs(df, features, targets))
    spread = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    facts = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), spread("x").alias("sx"), spread("y").alias("sy"))
    step = lambda c: F.rint(F.col(c) / F.col(f"s{c}") * SPREAD_STEPS).alias(c)
    places = cut_lineage(pairs.join(F.broadcast(facts), key).select(*key, step("x"), step("y")).groupBy(*key, *spot).agg(F.count(F.lit(1)).alias("c")))
    near = nearest_pairs(places.select(*key, *spot), places, spot, F.array(*spot), neighbors + 1, key, F.col("c"), chebyshev=True)
    gap = F.greatest(F.abs(F.col("x") - F.col("_rx")), F.abs(F.col("y") - F.col("_ry")))
    outward = Window.partitionBy(*key, *spot).orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    within = near.withColumn("d", gap).withColumn("held", F.sum("_copies").over(outward))
    # Rounding parts equal differences by up to two steps; nearer than 1 is equal.
    radius = within.filter(F.col("held") > neighbors).groupBy(*key, *spot).agg(F.greatest(F.min("d") - 2.0, F.lit(1.0)).alias("r"))
    radius = cut_lineage(radius.join(places, [*key, *spot]))
    # On each axis: rows below the upper edge come in, rows up to the lower edge go out again.
    null = F.lit(None).cast("double")
    edge = lambda axis, sign, at: F.struct(
        F.lit(axis).alias("axis"), (F.col(axis) + sign * F.col("r")).alias("v"), F.lit(at).alias("at"), F.lit(float(sign)).alias("sign")
    )
    edges = radius.select(*key, *spot, F.explode(F.array(*[e for c in spot for e in (edge(c, 1, 0), edge(c, -1, 2))])).alias("_e")).select(
        *key, *spot, "_e.*", F.lit(0).cast("long").alias("rows")
    )
    held = places.select(*key, null.alias("x"), null.alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in spot])).alias("_e"), "c")
    values = held.select(*key, "_e.axis", "_e.v", "c").groupBy(*key, "axis", "v").agg(F.sum("c").alias("rows"))
    values = values.select(*key, null.alias("x"), null.alias("y"), "axis", "v", F.lit(1).alias("at"), F.lit(0.0).alias("sign"), "rows")
    summed = running_sum(edges.unionByName(values), [*key, "axis"], ["v", "at"], "rows")
    counts = summed.filter("sign <> 0").groupBy(*key, *spot, "axis").agg(F.sum(F.col("sign") * F.col("running")).alias("m"))
    mean = counts.join(places, [*key, *spot]).groupBy(*key, "axis").agg((F.sum(F.col("c") * digamma(F.col("m"))) / F.sum("c")).alias("p"))
    both = mean.groupBy(*key).agg(F.sum("p").alias("p"))
    known = facts.filter(F.col("n") > neighbors).join(both, key)
    mi = F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(neighbors)) - F.col("p"))
    asked = df.sparkSession.createDataFrame(list(itertools.product(features, targets)), "a string, b string")
    found = asked.join(known.select(*key, mi.alias("mi")), key, "left")
    return found.select(F.col("a").alias("feature"), F.col("b").alias("target"), F.coalesce("mi", F.lit(0.0)).alias("mi"))


def _weighted_ranks(cells: DataFrame, side: str) -> DataFrame:
    """Average ranks of one side's distinct values, cells weighted by their rows."""
    tally = cells.groupBy("a", "b", side).agg(F.sum("c").alias("c"))
    return ranked_tally(tally, ["a", "b"], side, "c").withColumn("rank", F.col("before") + (F.col("c") + 1) / 2.0)


def binned_information(df: DataFrame, features: Sequence[str], targets: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of equal-frequency bins; missing features take the column median.

    A value's bin comes from its average rank, so equal values share a bin. Rows without the target
    are left out.
    """
    cells = _filled_pairs(df, features, targets).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    place = lambda: F.floor((F.col("rank") - 0.5) * bins / F.col("n"))
    bin_of = lambda side: _weighted_ranks(cells, side).select("a", "b", side, place().alias(f"b{side}"))
    joint = (
        cells.join(bin_of("x"), ["a", "b", "x"]).join(bin_of("y"), ["a", "b", "y"])
        .groupBy("a", "b", "bx", "by").agg(F.sum("c").alias("c"))
    )
    total = joint.groupBy("a", "b").agg(F.sum("c").alias("n"))
    px = joint.groupBy("a", "b", "bx").agg(F.sum("c").alias("cx"))
    py = joint.groupBy("a", "b", "by").agg(F.sum("c").alias("cy"))
    full = joint.join(total, ["a", "b"]).join(px, ["a", "b", "bx"]).join(py, ["a", "b", "by"])
    p = F.col("c") / F.col("n")
    term = p * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    return full.groupBy(F.col("a").alias("feature"), F.col("b").alias("target")).agg(F.sum(term).alias("mi"))


def grid_density(df: DataFrame, x: str, y: str, cell: float, value: str | None = None) -> DataFrame:
    """Counts per square cell, and the exact median of a column if one is named."""
    base = df if value is None else df.filter(F.col(value).isNotNull())
    placed = base.withColumns({"cx": F.floor(F.col(x) / cell), "cy": F.floor(F.col(y) / cell)})
    counts = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    if value is None:
        return counts
    return counts.join(exact_quantiles(placed, ["cx", "cy"], value, [0.5], [f"median_{value}"]), ["cx", "cy"])


def location_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def within_location_cv(df: DataFrame, targets: Sequence[str], places: int = 3, min_values: int = 3) -> DataFrame:
    keyed = df.withColumns({"lat": F.bround("lat", places), "lon": F.bround("lon", places)})
    long = melt(keyed, ["lat", "lon"], targets).filter(F.col("value").isNotNull())
    grouped = long.groupBy("lat", "lon", F.col("col").alias("target")).agg(
        F.count("value").alias("n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")
    )
    return grouped.filter((F.col("n") >= min_values) & (F.col("_m") != 0)).select(
        "lat", "lon", "target", (F.col("_s") / F.col("_m")).alias("cv")
    )


def monthly_trend(df: DataFrame, day: str, targets: Sequence[str]) -> DataFrame:
    """Mean and sample spread per year-month, months without a spread left out."""
    keyed = df.withColumn("month", F.trunc(day, "month"))
    long = melt(keyed, ["month"], targets).filter(F.col("value").isNotNull())
    return long.groupBy("month", F.col("col").alias("target")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    ).filter(F.col("std").isNotNull())


def seasonal_quartiles(df: DataFrame, day: str, targets: Sequence[str]) -> DataFrame:
    keyed = df.withColumn("month", F.month(day))
    long = melt(keyed, ["month"], targets)
    return exact_quantiles(long, ["month", "col"], "value", [0.25, 0.5, 0.75], ["q25", "median", "q75"]).withColumnRenamed("col", "target")


def year_month_pivot(df: DataFrame, day: str, target: str) -> DataFrame:
    """Medians with one row per year and one column per month."""
    keyed = df.withColumns({"year": F.year(day), "month": F.month(day)})
    med = exact_quantiles(keyed, ["year", "month"], target, [0.5], ["median"])
    return med.groupBy("year").agg(*[F.max(F.when(F.col("month") == m, F.col("median"))).alias(f"m{m}") for m in range(1, 13)])


def station_year_coverage(obs: DataFrame, day: str = "day", top: int = 40) -> DataFrame:
    """Rows per station and year, zeros filled in, for the stations with the most rows."""
    counts = obs.groupBy("station", F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("station").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), F.asc("station")).limit(top)
    kept = counts.join(best, "station")
    # One row per station and year that occurs at all: years are few, so they travel as one array.
    years = global_row(kept.agg(F.array_sort(F.collect_set("year")).alias("years")))["years"]
    frame = best.withColumn("year", F.explode(years))
    return frame.join(counts, ["station", "year"], "left").select("station", "year", F.coalesce("n", F.lit(0)).alias("n"), "total")


def density_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Normalised histogram over equal bins from minimum to maximum, the last bin closed."""
    ends = global_row(df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"), F.count(col).alias("n")))
    rows = df.filter(F.col(col).isNotNull()).withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(1.0 / bins)
    place = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    counted = rows.select(place.alias("bin"), lo.alias("_lo"), width.alias("_w"), F.col("_e.n").alias("_n")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"), F.first("_n").alias("_n")
    )
    return counted.select(
        "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"), "n",
        (F.col("n") / (F.col("_n") * F.col("_w"))).alias("density"),
    )


def within_group_ratio(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Row mean of the within-group sample spread over the total spread; groups of one are skipped.

    ``keep`` is false when the ratio is under 0.03 or the column hardly varies.
    """
    aggs = [F.stddev_samp(f).alias(f"_s_{f}") for f in features]
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    weigh = lambda f: F.sum(F.col(f"_s_{f}") * F.col("_rows")) / F.sum(F.when(F.col(f"_s_{f}").isNotNull(), F.col("_rows")))
    within = per_group.agg(*[weigh(f).alias(f) for f in features])
    total = df.agg(*[F.stddev_samp(f).alias(f) for f in features])
    long = lambda d, name: melt(d, [], features).select(F.col("col").alias("feature"), F.col("value").alias(name))
    both = long(within, "within_std").join(long(total, "total_std"), "feature")
    flat = F.coalesce(F.col("total_std"), F.lit(0.0)) < 1e-8
    ratio = F.when(~flat, F.col("within_std") / F.when(~flat, F.col("total_std")))
    return both.withColumn("ratio", ratio).withColumn("keep", ~flat & F.coalesce(F.col("ratio") >= 0.03, F.lit(True)))
