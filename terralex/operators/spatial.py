"""Coordinate matching, nearest neighbours and radius counts without pairing everything.

Samples repeat coordinates heavily, so every operator first reduces to distinct coordinates and
joins its answer back. Lookups go through grid cells, as equi-joins.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.functions.scalars import EARTH_RADIUS_KM, degree_distance, haversine_km
from terralex.functions.vectors import mean_of, weighted_mean
from terralex.operators.space_tree import nearest_pairs
from terralex.session import cut_lineage

COORD_TOL = 0.005
DISCOVERY_TOL = 0.02


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def _around(size_lat: float, size_lon: float, lat: Column, lon: Column, reach_lat: int = 1, reach_lon: int = 1) -> Column:
    """The cells within reach of a point's own cell, as an array of structs."""
    ilat, ilon = cell(lat, size_lat), cell(lon, size_lon)
    shifts = itertools.product(range(-reach_lat, reach_lat + 1), range(-reach_lon, reach_lon + 1))
    return F.array(*[F.struct((ilat + a).alias("ci"), (ilon + b).alias("cj")) for a, b in shifts])


def box_pairs(points: DataFrame, registry: DataFrame, tol: float, payload: Sequence[str]) -> DataFrame:
    """Distinct points with every registry place inside the box ``|dlat|, |dlon| < tol``.

    The registry is the smaller side, so it is the one copied into the neighbouring cells.
    """
    left = points.select("lat", "lon").distinct()
    left = left.withColumns({"ci": cell(F.col("lat"), tol), "cj": cell(F.col("lon"), tol)})
    right = registry.select(
        F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), *payload,
        F.explode(_around(tol, tol, F.col("lat"), F.col("lon"))).alias("_c"),
    ).select("_rlat", "_rlon", *payload, "_c.ci", "_c.cj")
    near = (F.abs(F.col("lat") - F.col("_rlat")) < tol) & (F.abs(F.col("lon") - F.col("_rlon")) < tol)
    return left.join(right, ["ci", "cj"]).filter(near).drop("ci", "cj")


def coord_to_station(samples: DataFrame, registry: DataFrame, ord_col: str = "station", tol: float = COORD_TOL) -> DataFrame:
    """Add the first registry station (by ``ord_col``) whose box holds the sample; null if none."""
    # Only the first entry of a coordinate can win, so copies are dropped before pairing.
    firsts = registry.groupBy("lat", "lon").agg(F.min(F.struct(F.col(ord_col).alias("o"), "station")).alias("_s"))
    pairs = box_pairs(samples, firsts, tol, ["_s"])
    best = pairs.groupBy("lat", "lon").agg(F.min("_s").alias("_s"))
    kept = [c for c in samples.columns if c != "station"]
    return samples.join(best, ["lat", "lon"], "left").select(*kept, F.col("_s.station").alias("station"))


def station_discovery(stations: DataFrame, locations: DataFrame, tol: float = DISCOVERY_TOL, nearest: bool = False) -> DataFrame:
    """Per station the first location in (lat, lon) order inside its box, and its degree distance.

    ``nearest`` takes the closest location instead.
    """
    places = locations.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).distinct()
    pairs = box_pairs(places, stations, tol, ["station"])
    dist = degree_distance(F.col("lat"), F.col("lon"), F.col("_rlat"), F.col("_rlon"))
    item = F.struct("lat", "lon", dist.alias("dist"))
    order = F.struct(dist.alias("dist"), "lat", "lon") if nearest else F.struct("lat", "lon")
    best = pairs.groupBy("station", "_rlat", "_rlon").agg(F.min_by(item, order).alias("m"))
    return best.select("station", F.col("_rlat").alias("lat"), F.col("_rlon").alias("lon"),
                       F.col("m.lat").alias("match_lat"), F.col("m.lon").alias("match_lon"), "m.dist")


def leakage_anti_join(obs: DataFrame, registry: DataFrame, *sample_sets: DataFrame) -> DataFrame:
    """History rows whose station and day appear in none of the sample sets."""
    keys = None
    for s in sample_sets:
        matched = coord_to_station(s, registry).filter(F.col("station").isNotNull()).select("station", "day")
        keys = matched if keys is None else keys.unionByName(matched)
    return obs.join(keys.distinct(), ["station", "day"], "left_anti")


# --- exact k nearest neighbours --------------------------------------------------------------


class Metric:
    """Coordinates in which nearer in space means nearer in the metric."""

    def __init__(self, axes, distance):
        self.axes, self.distance = axes, distance


def _unit_sphere(lat: Column, lon: Column) -> list[Column]:
    p, q = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]


DEGREES = Metric(lambda lat, lon: [lat, lon], degree_distance)
HAVERSINE = Metric(_unit_sphere, haversine_km)


def knn(
    points: DataFrame,
    refs: DataFrame,
    ref_id: str,
    k: int,
    metric: Metric = DEGREES,
    by: Sequence[str] = (),
    payload: Sequence[str] = (),
    name: str = "near",
) -> DataFrame:
    """For each distinct (by…, lat, lon) of ``points``, its k nearest ``refs`` as an ordered array.

    Array elements are structs (dist, id, payload…), ordered by distance and then id. Exact at any
    density: an adaptive tree finds the candidates (``space_tree``), and distances settle the order. A
    place without both coordinates has no neighbours and is nobody's.
    """
    by, payload = list(by), list(payload)
    place = [*by, "lat", "lon"]
    there = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in place]) & ~F.isnan("lat") & ~F.isnan("lon")

    # At most k references of one coordinate can be among anyone's k nearest: one row per coordinate.
    same = Window.partitionBy(*place).orderBy("id")
    held = cut_lineage(
        refs.filter(there).select(*[F.col(c).cast(points.schema[c].dataType).alias(c) for c in by], F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(ref_id).alias("id"), *payload)
        .withColumn("_n", F.row_number().over(same))
        .filter(F.col("_n") <= k)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(F.struct("id", *payload))).alias("_held"))
    )
    asks = points.filter(there).select(*by, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct()
    axes = F.array(*[a.cast("double") for a in metric.axes(F.col("lat"), F.col("lon"))])
    pairs = nearest_pairs(asks, held, ["lat", "lon"], axes, k, by, F.size("_held")).withColumn(
        "dist", metric.distance(F.col("lat"), F.col("lon"), F.col("_rlat"), F.col("_rlon"))
    )
    # k coordinates hold k references; equally far ones are all kept so that ids settle the tie.
    best = Window.partitionBy(*place).orderBy("dist")
    kept = pairs.withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= k)
    rows = held.select(*by, F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), "_held")
    full = kept.join(rows, [*by, "_rlat", "_rlon"])
    item = F.transform("_held", lambda x: F.struct(F.col("dist"), x["id"].alias("id"), *[x[c].alias(c) for c in payload]))
    ordered = F.sort_array(F.flatten(F.collect_list(item)))
    return full.groupBy(*place).agg(F.slice(ordered, 1, k).alias(name))


def nearest_station_fill(
    samples: DataFrame, stations: DataFrame, obs: DataFrame, cols: Sequence[str], max_deg: float = 0.5, max_days: int = 30,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Samples without a station or any of the columns: nearest station's nearest row in time."""
    from terralex.operators.temporal import nearest_rows

    empty = F.col("station").isNull() & F.coalesce(*[F.col(c) for c in cols]).isNull()
    needy = samples.filter(empty)
    near = knn(needy, stations, "station", 1).withColumn("_hit", F.col("near")[0]).filter(F.col("_hit.dist") <= max_deg)
    near = near.select("lat", "lon", F.col("_hit.id").alias("_near"))
    wanted = needy.select("lat", "lon", "day").join(near, ["lat", "lon"]).select(F.col("_near").alias("station"), "day").distinct()
    found = nearest_rows(wanted, obs, F.struct(*cols), max_days, order).select(F.col("station").alias("_near"), "day", "found")
    joined = samples.join(near, ["lat", "lon"], "left").join(found, ["_near", "day"], "left")
    fill = {c: F.when(empty, F.col(f"found.{c}")) for c in cols}
    return joined.select(*[F.coalesce(c, fill[c]).alias(c) if c in fill else F.col(c) for c in samples.columns])


def idw_station_fill(samples: DataFrame, features: DataFrame, stations: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """Station features by station; samples without one get the inverse-distance mean of k stations.

    Weights are 1/(degrees + 0.001), renormalised per column over the stations that have a value.
    """
    own = samples.join(features.select("station", *cols), "station", "left")
    lost = own.filter(F.col("station").isNull())
    refs = stations.join(features.select("station", *cols), "station", "left")
    near = knn(lost, refs, "station", k, payload=cols).withColumn(
        "near", F.transform("near", lambda x: F.struct(*[x[c].cast("double").alias(c) for c in cols], (1.0 / (x["dist"] + 0.001)).alias("w")))
    )
    far = near.select("lat", "lon", *[weighted_mean(F.col("near"), c, "w").alias(f"_f_{c}") for c in cols])
    joined = own.join(far, ["lat", "lon"], "left")
    pick = lambda c: F.when(F.col("station").isNull(), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*samples.columns, *[pick(c) for c in cols])


def neighbor_stations(stations: DataFrame, k: int = 5, max_deg: float = 2.0) -> DataFrame:
    """Up to k other stations of the same region within reach: (station, neighbor, dist)."""
    near = knn(stations, stations, "station", k + 1, by=["region"])
    # k+1 always include the station itself unless more than k others share its coordinate.
    pairs = stations.join(near, ["region", "lat", "lon"]).select("station", F.explode("near").alias("n"))
    pairs = pairs.filter((F.col("n.id") != F.col("station")) & (F.col("n.dist") <= max_deg))
    rank = Window.partitionBy("station").orderBy("n.dist", "n.id")
    return pairs.withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= k).select(
        "station", F.col("n.id").alias("neighbor"), F.col("n.dist").alias("dist")
    )


def neighbor_idw(
    samples: DataFrame, stations: DataFrame, obs: DataFrame, cols: Sequence[str], k: int = 5, max_deg: float = 2.0,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """What the neighbouring stations last measured before the sample's day.

    Each neighbour gives its last row strictly before the day, whose values may be null. Per column:
    mean with weight 1/(degrees + 0.01), minimum and maximum; and over neighbours with any value,
    their count and mean distance.
    """
    from terralex.operators.temporal import asof_payload, sample_days

    asked = sample_days(samples)
    pairs = asked.join(neighbor_stations(stations, k, max_deg), "station")
    wanted = pairs.select(F.col("neighbor").alias("station"), "day").distinct()
    last = asof_payload(wanted, obs, F.struct(*cols), "_row", "before", order=order).withColumnRenamed("station", "neighbor")
    joined = pairs.join(last, ["neighbor", "day"]).withColumn("w", 1.0 / (F.col("dist") + 0.01))
    aggs = []
    for c in cols:
        v = F.col(f"_row.{c}")
        has_value = v.isNotNull()
        aggs += [
            (F.sum(v * F.col("w")) / F.sum(F.when(has_value, F.col("w")))).alias(f"nbr_{c}_wmean"),
            F.min(v).alias(f"nbr_{c}_min"),
            F.max(v).alias(f"nbr_{c}_max"),
        ]
    some = F.coalesce(*[F.col(f"_row.{c}") for c in cols]).isNotNull()
    count = F.sum(some.cast("bigint"))
    aggs += [F.when(count > 0, count).alias("nbr_n"), F.avg(F.when(some, F.col("dist"))).alias("nbr_mean_dist")]
    return samples.join(joined.groupBy("station", "day").agg(*aggs), ["station", "day"], "left")


def neighbour_means(near: Column, cols: Sequence[str], ks: Sequence[int]) -> dict[str, Column]:
    """Plain and 1/(km+1)-weighted means of the first k of an array of neighbours, and the nearest km."""
    out: dict[str, Column] = {}
    for k in ks:
        first = F.slice(near, 1, k)
        for c in cols:
            values = F.transform(first, lambda x: F.struct(x[c].cast("double").alias("v"), (1.0 / (x["dist"] + 1.0)).alias("w")))
            out[f"knn{k}_{c}_mean"] = mean_of(F.transform(values, lambda x: x["v"]))
            # No neighbour with a value: the weighted mean is 0, the plain mean missing.
            out[f"knn{k}_{c}_wmean"] = F.coalesce(weighted_mean(values, "v", "w", floor=1e-8), F.lit(0.0))
    out["nn_dist_km"] = F.get(near, F.lit(0))["dist"]
    return out


def fold_neighbours(df: DataFrame, id_col: str, cols: Sequence[str], k: int, folds: int, fold: str = "fold", name: str = "by_fold") -> DataFrame:
    """Add the k + 1 nearest rows of every fold, as an array of (fold, near): one search for all folds.

    Whatever folds a row may see, its nearest rows among them are merged from this array.
    """
    asks = df.select("lat", "lon").distinct().withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    near = knn(asks, df, id_col, k + 1, metric=HAVERSINE, by=[fold], payload=cols)
    held = near.groupBy("lat", "lon").agg(F.collect_list(F.struct(F.col(fold).alias("fold"), "near")).alias(name))
    return df.join(held, ["lat", "lon"], "left").select(*df.columns, name)


def seen_neighbours(by_fold: str, left_out: int, id_col: str) -> Column:
    """The neighbours of a row outside one fold, nearest first, itself left out."""
    lists = F.transform(F.filter(by_fold, lambda e: e["fold"] != left_out), lambda e: e["near"])
    return F.filter(F.array_sort(F.flatten(lists)), lambda x: x["id"] != F.col(id_col))


def haversine_knn_features(
    query: DataFrame, ref: DataFrame, id_col: str, cols: Sequence[str], ks: Sequence[int] = (5, 10), is_train: bool = False
) -> DataFrame:
    """Per column the plain and the 1/(km+1)-weighted mean over the k nearest rows, and the nearest km.

    In training a row never counts as its own neighbour; it is told apart by id.
    """
    top = max(ks)
    need = top + 1 if is_train else top
    near = knn(query, ref, id_col, need, metric=HAVERSINE, payload=cols)
    joined = query.join(near, ["lat", "lon"], "left")
    others = F.filter("near", lambda x: x["id"] != F.col(id_col)) if is_train else F.col("near")
    joined = joined.withColumn("_nb", F.slice(others, 1, top))
    out = neighbour_means(F.col("_nb"), cols, ks)
    return joined.select(*query.columns, *[v.alias(n) for n, v in out.items()])


def season_idw_enrichment(obs: DataFrame, enriched: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """Fill features from the k nearest enriched locations, by season.

    A location offers its median of the season, else its median of all time. Weights are 1/(km+1),
    renormalised over the locations with a value.
    """
    from terralex.functions.scalars import season_bucket
    from terralex.operators.quantiles import medians_wide

    fixed = {"lat": F.bround("lat", 4), "lon": F.bround("lon", 4)}
    source = enriched.withColumn("season", season_bucket(F.col("day"))).withColumns(fixed)
    by_season = medians_wide(source, ["lat", "lon", "season"], cols)
    by_place = medians_wide(source, ["lat", "lon"], cols)
    places = source.select("lat", "lon").distinct().withColumn("place", F.struct("lat", "lon"))
    asked = obs.withColumn("season", season_bucket(F.col("day"))).select("lat", "lon", "season").distinct()
    near = knn(asked, places, "place", k, metric=HAVERSINE)
    flat = (
        asked.join(near, ["lat", "lon"])
        .select("lat", "lon", "season", F.explode("near").alias("n"))
        .select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), "season", "n.id.lat", "n.id.lon", "n.dist")
        .join(by_season.select("lat", "lon", "season", *[F.col(c).alias(f"_s_{c}") for c in cols]), ["lat", "lon", "season"], "left")
        .join(by_place.select("lat", "lon", *[F.col(c).alias(f"_t_{c}") for c in cols]), ["lat", "lon"], "left")
        .withColumn("w", 1.0 / (F.col("dist") + 1.0))
    )
    value = {c: F.coalesce(f"_s_{c}", f"_t_{c}") for c in cols}
    means = [(F.sum(v * F.col("w")) / F.sum(F.when(v.isNotNull(), F.col("w")))).alias(c) for c, v in value.items()]
    some = F.max(F.coalesce(*value.values()).isNotNull().cast("int"))
    grouped = flat.groupBy(F.col("qlat").alias("lat"), F.col("qlon").alias("lon"), "season").agg(
        *means, some.alias("has_enrichment"), F.when(some == 1, F.min("dist")).alias("enrichment_km")
    )
    tagged = obs.withColumn("season", season_bucket(F.col("day")))
    return tagged.join(grouped, ["lat", "lon", "season"], "left").withColumn(
        "has_enrichment", F.coalesce("has_enrichment", F.lit(0))
    )


# --- points of interest ----------------------------------------------------------------------

def radius_pairs(locs: DataFrame, pois: DataFrame, radius_km: float) -> DataFrame:
    """Per distinct location and tag, how many points lie within the radius and how near the nearest is.

    Cells are cubes over points of the unit sphere, one chord of the radius wide, so poles and the
    date line are like any other place. Points of one coordinate and tag are counted first, so a pile
    of copies pairs once.
    """
    import math

    half_angle = min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2)
    side = max(2 * math.sin(half_angle) * 1.0001, 1e-9)

    def cube() -> list[Column]:
        lat, lon = F.radians("lat"), F.radians("lon")
        xyz = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
        return [cell(v, side).alias(n) for v, n in zip(xyz, ("ci", "cj", "ck"))]

    piles = pois.groupBy("lat", "lon", "tag").agg(F.count(F.lit(1)).alias("_n"))
    near = [F.struct(*[F.lit(s).alias(n) for s, n in zip(shift, "abc")]) for shift in itertools.product((-1, 0, 1), repeat=3)]
    left = locs.select("lat", "lon").distinct().select("lat", "lon", *cube()).withColumn("_s", F.explode(F.array(*near)))
    left = left.select("lat", "lon", (F.col("ci") + F.col("_s.a")).alias("ci"), (F.col("cj") + F.col("_s.b")).alias("cj"), (F.col("ck") + F.col("_s.c")).alias("ck"))
    right = piles.select(F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), "tag", "_n", *cube())
    pairs = left.join(right, ["ci", "cj", "ck"]).withColumn(
        "km", haversine_km(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"))
    ).filter(F.col("km") <= radius_km)
    deg = degree_distance(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"))
    return pairs.groupBy("lat", "lon", "tag").agg(F.sum("_n").alias("n"), F.min(deg).alias("nearest_deg"))


def poi_radius_features(
    locs: DataFrame, pois: DataFrame, radius_km: float, counts: Sequence[str], barriers: Sequence[str] = (), dominant: Sequence[str] = ()
) -> DataFrame:
    """Tag counts, nearest barrier and dominant tag around each distinct location.

    The dominant tag is the most frequent one, the first listed on a tie, as its 1-based place in
    the list; 0 if there is none. The barrier distance is degrees times 111320.
    """
    near = radius_pairs(locs, pois, radius_km)
    n = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("n"))), F.lit(0))
    aggs = [n(tag).alias(f"n_{tag.lower()}") for tag in counts]
    if barriers:
        is_barrier = F.col("tag").isin(*barriers)
        aggs += [
            F.coalesce(F.max(is_barrier.cast("int")), F.lit(0)).alias("has_barrier"),
            (F.min(F.when(is_barrier, F.col("nearest_deg"))) * 111320.0).alias("barrier_m"),
        ]
    grouped = near.groupBy("lat", "lon").agg(*aggs)
    out = locs.select("lat", "lon").distinct().join(grouped, ["lat", "lon"], "left")
    zero = {f"n_{t.lower()}": 0 for t in counts}
    if barriers:
        zero["has_barrier"] = 0
    out = out.na.fill(zero)
    if dominant:
        cols = [F.col(f"n_{t.lower()}") for t in dominant]
        most = F.greatest(*cols)
        pick = F.lit(0)
        for i in range(len(cols), 0, -1):
            pick = F.when(cols[i - 1] == most, F.lit(i)).otherwise(pick)
        out = out.withColumn("dominant", F.when(most > 0, pick).otherwise(F.lit(0)))
    return out
