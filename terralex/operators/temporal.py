"""Lags, rolling means, as-of and nearest-in-time lookups over station histories.

Histories have one row or a few per station and day, so a station's rows are bounded by the calendar.
Several rows of a day are told apart by ``order``, by default their ``date`` (as the reader of station
files gives it); a history without either must have one row a day. Samples are unbounded: they are
reduced to their distinct station-days before any ordered step, and joined back on that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.operators.scan import SEGMENT_DAYS, carry_last, day_segment, dense_position, with_halo

MICROS_PER_DAY = 86_400_000_000


def row_order(obs: DataFrame, order: Sequence[str] | None) -> list[str]:
    """What orders the rows of a day: the columns named, else ``date`` where there is one."""
    if order is not None:
        return list(order)
    return ["date"] if "date" in obs.columns else []


def needed_order(obs: DataFrame, order: Sequence[str] | None) -> list[str]:
    found = row_order(obs, order)
    if not found:
        raise ValueError("which row of a day is the first? Name the columns that order them, or give a date column")
    return found


def daily_grain(obs: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First row of each station-day by ``order``; combined map-side."""
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return obs.groupBy("station", "day").agg(first).select("station", "day", "_row.*")


def lag_last_valid(obs: DataFrame, cols: Sequence[str], segment_days: int = SEGMENT_DAYS, row_id: str | None = None) -> DataFrame:
    """Per column, its last non-null value on an earlier row of the station, and the days since.

    Where a day has several rows, ``row_id`` orders them; without it days must be unique per station.
    """
    order = ["day", row_id] if row_id else ["day"]
    held: dict[str, Column] = {}
    for c in cols:
        held[f"lag_{c}"] = F.col(c)
        held[f"lag_{c}_on"] = F.when(F.col(c).isNotNull(), F.col("day"))
    out = carry_last(obs, ["station"], order, day_segment(F.col("day"), segment_days), held)
    return out.select(
        *obs.columns,
        *[F.col(f"lag_{c}") for c in cols],
        *[F.datediff("day", F.col(f"lag_{c}_on")).alias(f"lag_{c}_days") for c in cols],
    )


def rolling_last_n(
    obs: DataFrame, col: str, sizes: Sequence[int], segment_days: int = SEGMENT_DAYS, block: int = 4096, row_id: str | None = None
) -> DataFrame:
    """Mean of the last n non-null values before the row.

    Where a day has several rows, ``row_id`` orders them; without it days must be unique per station.

    A row without a value repeats what the latest row with a value got, so that row's own value
    does not enter. The first row with a value has no mean.
    """
    segment = day_segment(F.col("day"), segment_days)
    place = ["day", row_id] if row_id else ["day"]
    valued = obs.filter(F.col(col).isNotNull()).select("station", *place, col)
    placed = with_halo(
        dense_position(valued, ["station"], place, segment), "pos", block, before=max(sizes)
    )
    order = Window.partitionBy("station", "_block").orderBy("pos")
    means = (
        placed.select(
            "station", *place, "_core",
            *[F.avg(col).over(order.rowsBetween(-n, -1)).alias(f"_m{n}") for n in sizes],
        )
        .filter("_core")
        .select("station", *place, F.struct(*[F.col(f"_m{n}") for n in sizes]).alias("_means"))
    )
    joined = obs.join(means, ["station", *place], "left")
    # A first row's mean is null inside a non-null struct, so the struct itself is what carries.
    carried = carry_last(joined, ["station"], place, segment, {"_got": F.col("_means")}, include_current=True)
    return carried.select(*obs.columns, *[F.col(f"_got._m{n}").alias(f"roll{n}_{col}") for n in sizes])


def sample_days(samples: DataFrame) -> DataFrame:
    """The distinct station-days asked for; rows without a station have no history."""
    return samples.filter(F.col("station").isNotNull()).select("station", "day").distinct()


def asof_payload(
    wanted: DataFrame, obs: DataFrame, payload: Column, name: str, side: str = "before",
    segment_days: int = SEGMENT_DAYS, order: Sequence[str] | None = None,
) -> DataFrame:
    """For each wanted station-day the payload of the nearest history row.

    ``side``: ``before`` is strictly earlier, ``upto`` may be the same day, ``after`` is strictly later,
    ``from`` is the same day or later. Of a day's rows the last counts looking back, the first looking
    ahead. Both sides are tagged and stacked, so this is one ordered pass and no range join.
    """
    reverse = side in ("after", "from")
    # The tag orders rows of one day so that only the allowed ones come first.
    history_tag = 1 if side in ("before", "from") else 0
    within = [F.col(c).alias(f"_o{i}") for i, c in enumerate(row_order(obs, order))]
    tagged = obs.select("station", "day", F.lit(history_tag).alias("_tag"), payload.alias("_pay"), *within).unionByName(
        wanted.select("station", "day", F.lit(1 - history_tag).alias("_tag")), allowMissingColumns=True
    )
    tagged = tagged.withColumn("_at", F.unix_date("day") * 2 + F.col("_tag"))
    carried = carry_last(
        tagged, ["station"], ["_at", *[f"_o{i}" for i in range(len(within))]], day_segment(F.col("day"), segment_days), {name: F.col("_pay")}, reverse=reverse
    )
    return carried.filter(F.col("_tag") == 1 - history_tag).select("station", "day", name)


def asof_last(samples: DataFrame, obs: DataFrame, col: str, segment_days: int = SEGMENT_DAYS, order: Sequence[str] | None = None) -> DataFrame:
    """Last non-null value strictly before the sample's day at its station, and the days since."""
    valued = obs.filter(F.col(col).isNotNull())
    pay = F.struct(F.col(col).alias("v"), F.col("day").alias("d"))
    found = asof_payload(sample_days(samples), valued, pay, "_hit", "before", segment_days, order)
    return samples.join(found, ["station", "day"], "left").select(
        *samples.columns,
        F.col("_hit.v").alias(f"asof_{col}"),
        F.datediff("day", F.col("_hit.d")).alias(f"asof_{col}_days"),
    )


def trailing_window_join(samples: DataFrame, obs: DataFrame, col: str, windows: Sequence[int]) -> DataFrame:
    """Mean of the non-null values in ``[day - N, day)`` for each N, one pass over tagged rows.

    The window partition is one station of daily rows plus its distinct sample days, so it is
    bounded by the calendar even for a station with most of the samples.
    """
    wanted = sample_days(samples)
    tagged = obs.select("station", "day", F.col(col).cast("double").alias("_v"), F.lit(False).alias("_ask")).unionByName(
        wanted.select("station", "day", F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_ask"))
    )
    order = Window.partitionBy("station").orderBy(F.unix_date("day"))
    means = {f"trail{n}_{col}": F.avg("_v").over(order.rangeBetween(-n, -1)) for n in windows}
    found = tagged.withColumns(means).filter("_ask").drop("_v", "_ask")
    return samples.join(found, ["station", "day"], "left").select(*samples.columns, *means)


def recent_arrays(
    obs: DataFrame, payload: Column, n: int, order_desc: bool, segment_days: int = SEGMENT_DAYS, block: int = 4096,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Per history row an array of its own and up to n-1 neighbouring payloads, oldest first.

    Neighbours are the earlier rows, or the later ones with ``order_desc`` false.
    """
    within = row_order(obs, order)
    placed = dense_position(
        obs.select("station", "day", *within, payload.alias("_p")), ["station"], ["day", *within], day_segment(F.col("day"), segment_days)
    )
    edge = {"before": n} if order_desc else {"after": n}
    halo = with_halo(placed, "pos", max(block, n), **edge)
    by_pos = Window.partitionBy("station", "_block").orderBy("pos")
    frame = by_pos.rowsBetween(-(n - 1), 0) if order_desc else by_pos.rowsBetween(0, n - 1)
    return halo.withColumn("items", F.collect_list("_p").over(frame)).filter("_core").select("station", "day", *within, "items")


def history_sequences(
    samples: DataFrame, obs: DataFrame, cols: Sequence[str], n: int, excluded: DataFrame | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The last n history rows before the sample's day, as an array of structs; under 2 rows gives null.

    Each element holds the columns and the cyclic month and day-of-year, oldest first.
    """
    from terralex.functions.scalars import cyclic

    usable = obs.join(excluded, ["station", "day"], "left_anti") if excluded is not None else obs
    month = cyclic(F.month("day"), 12)
    doy = cyclic(F.dayofyear("day"), 365.25)
    step = F.struct(
        F.col("day").alias("date"),
        *[F.col(c).cast("double").alias(c) for c in cols],
        month[0].alias("month_sin"), month[1].alias("month_cos"),
        doy[0].alias("doy_sin"), doy[1].alias("doy_cos"),
    )
    within = row_order(usable, order)
    arrays = recent_arrays(usable, step, n, order_desc=True, order=within)
    found = asof_payload(sample_days(samples), arrays, F.col("items"), "_seq", "before", order=within)
    return samples.join(found, ["station", "day"], "left").select(
        *samples.columns, F.when(F.size("_seq") >= 2, F.col("_seq")).alias("sequence")
    )


def sequence_normalize(seqs: DataFrame, features: Sequence[str], n: int, fit_on: DataFrame | None = None) -> DataFrame:
    """z-score every step over all steps of all sequences, nulls to 0, zero-padded at the end to n.

    A feature's spread below 1e-8 counts as 1. Output: one array of doubles per step.
    """
    steps = (fit_on if fit_on is not None else seqs).select(F.explode("sequence").alias("s"))
    stats = steps.agg(
        F.array(*[F.avg(F.col("s")[f]) for f in features]).alias("mean"),
        F.array(*[F.stddev_pop(F.col("s")[f]) for f in features]).alias("std"),
    )
    from terralex.operators.quantiles import global_row

    with_stats = seqs.withColumn("_st", global_row(stats))
    mean, std = F.col("_st.mean"), F.col("_st.std")
    safe = [F.when(std[i] < 1e-8, F.lit(1.0)).otherwise(std[i]) for i in range(len(features))]
    scaled = F.transform(
        "sequence",
        lambda s: F.array(*[F.coalesce((s[f] - mean[i]) / safe[i], F.lit(0.0)) for i, f in enumerate(features)]),
    )
    zero = F.array(*[F.lit(0.0) for _ in features])
    padded = F.concat(scaled, F.array_repeat(zero, F.lit(n) - F.size("sequence")))
    length = F.when(F.col("sequence").isNull(), F.lit(0)).otherwise(F.size("sequence"))
    return with_stats.withColumn("normalized", padded).withColumn("length", length).drop("_st")


def nearest_rows(wanted: DataFrame, obs: DataFrame, payload: Column, max_days: int | None, order: Sequence[str] | None = None) -> DataFrame:
    """The history row nearest to each wanted station-day: the day's own first row, else the nearer of the last
    row before and the first after, the earlier one in a tie of days."""
    pay = F.struct(F.col("day").alias("d"), payload.alias("p"))
    back = asof_payload(wanted, obs, pay, "_b", "before", order=order)
    ahead = asof_payload(wanted, obs, pay, "_a", "from", order=order)
    gap_b, gap_a = F.datediff("day", F.col("_b.d")), F.datediff(F.col("_a.d"), "day")
    earlier = F.col("_a").isNull() | (gap_b <= gap_a)
    hit = F.when(F.col("_b").isNotNull() & earlier, F.col("_b")).otherwise(F.col("_a"))
    out = back.join(ahead, ["station", "day"]).withColumn("hit", hit)
    gap = F.abs(F.datediff("day", F.col("hit.d")))
    out = out.withColumn("gap", gap)
    if max_days is not None:
        out = out.withColumn("hit", F.when(F.col("gap") <= max_days, F.col("hit")))
    return out.select("station", "day", F.col("hit.p").alias("found"), F.when(F.col("hit").isNotNull(), F.col("gap")).alias("gap"))


def sameday_lookup(samples: DataFrame, obs: DataFrame, cols: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Fill null columns of a sample from its station's first row of the same day, nulls there included.

    ``order`` or a column ``date`` tells which row is the first.
    """
    first = daily_grain(obs, needed_order(obs, order), cols)
    right = first.select("station", "day", *[F.col(c).alias(f"_l_{c}") for c in cols])
    joined = samples.join(right, ["station", "day"], "left")
    return _fill(samples, joined, {c: F.col(f"_l_{c}") for c in cols})


def nearest_date_fill(
    samples: DataFrame, obs: DataFrame, cols: Sequence[str], max_days: int = 30, order: Sequence[str] | None = None
) -> DataFrame:
    """Samples at a station with none of the columns: take the nearest history row within the limit.

    The nearest row within 30 days is also the nearest within 7 days whenever there is one there,
    so one lookup serves both limits.
    """
    empty = F.coalesce(*[F.col(c) for c in cols]).isNull()
    wanted = sample_days(samples.filter(empty))
    found = nearest_rows(wanted, obs, F.struct(*cols), max_days, order)
    joined = samples.join(found, ["station", "day"], "left")
    return _fill(samples, joined, {c: F.when(empty, F.col(f"found.{c}")) for c in cols})


def _fill(samples: DataFrame, joined: DataFrame, source: dict[str, Column]) -> DataFrame:
    kept = [F.coalesce(c, source[c]).alias(c) if c in source else F.col(c) for c in samples.columns]
    added = [v.alias(c) for c, v in source.items() if c not in samples.columns]
    return joined.select(*kept, *added)


def temporal_interpolation(samples: DataFrame, obs: DataFrame, col: str, k: int, order: Sequence[str] | None = None) -> DataFrame:
    """Mean of the k values nearest in time, weight 1/(days+1), never the sample's own day.

    Equal gaps are taken earlier day first. Confidence falls with the smallest gap.
    """
    valued = obs.filter(F.col(col).isNotNull())
    item = F.struct(F.col("day").alias("d"), F.col(col).cast("double").alias("v"))
    wanted, within = sample_days(samples), row_order(obs, order)
    back = asof_payload(wanted, recent_arrays(valued, item, k, True, order=within), F.col("items"), "_b", "before", order=within)
    ahead = asof_payload(wanted, recent_arrays(valued, item, k, False, order=within), F.col("items"), "_a", "after", order=within)
    both = back.join(ahead, ["station", "day"])
    none = F.array().cast("array<struct<d:date,v:double>>")
    every = F.concat(F.coalesce("_b", none), F.coalesce("_a", none))
    near = F.transform(
        every,
        lambda x: F.struct(
            F.abs(F.datediff("day", x["d"])).alias("gap"), x["d"].alias("d"), x["v"].alias("v"),
            (1.0 / (F.abs(F.datediff("day", x["d"])) + 1.0)).alias("w"),
        ),
    )
    from terralex.functions.vectors import weighted_mean

    top = both.withColumn("_near", F.slice(F.array_sort(near), 1, k))
    gap = F.col("_near")[0]["gap"]
    # Confidence by smallest gap in days.
    conf = F.when(gap <= 7, 0.95).when(gap <= 30, 0.85).when(gap <= 90, 0.60).when(gap <= 180, 0.35).otherwise(0.15)
    some = F.size("_near") > 0
    scored = top.select(
        "station", "day",
        F.when(some, weighted_mean(F.col("_near"), "v", "w")).alias("interp"),
        F.when(some, conf).otherwise(0.0).alias("interp_conf"),
    )
    return samples.join(scored, ["station", "day"], "left").select(
        *samples.columns, "interp", F.coalesce("interp_conf", F.lit(0.0)).alias("interp_conf")
    )
