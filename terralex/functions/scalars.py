"""Column-level feature functions (built-in expressions only, so they stay in codegen)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
EARTH_RADIUS_KM = 6371.0


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible draw in [0, 1) from the row's keys, the same on every engine with md5."""
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    digits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10)
    # Never null, so no plan evaluates the hash once more just to test it.
    return F.coalesce(digits, F.lit("0")).cast("bigint") / F.lit(4294967296.0)


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation as an aggregate over the rows that have both: NaN if one column is constant, null below two rows.

    ``corr`` divides by the product of the spreads whatever it is, which is an error in ANSI mode if that is 0.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.when(spread > 0, F.covar_pop(x, y) / spread).otherwise(float("nan"))
    return F.when(F.count(x) >= 2, r)


# --- calendar ---------------------------------------------------------------------------------


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_features(df: DataFrame, date_col: str) -> DataFrame:
    day = F.col(date_col)
    month_sin, month_cos = cyclic(F.month(day), 12)
    doy_sin, doy_cos = cyclic(F.dayofyear(day), 365.25)
    return df.withColumns(
        {
            "month": F.month(day),
            "day_of_year": F.dayofyear(day),
            "year": F.year(day),
            "month_sin": month_sin,
            "month_cos": month_cos,
            "doy_sin": doy_sin,
            "doy_cos": doy_cos,
        }
    )


def year_fraction(day: Column) -> Column:
    return F.year(day) + F.dayofyear(day) / F.lit(365.25)


def season_bucket(day: Column) -> Column:
    month = F.month(day)
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .when(month.isin(9, 10, 11), "SON")
    )


def whole_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


# --- ratios and interactions -----------------------------------------------------------------


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + F.lit(EPS))


# Output name -> (first band, second band).
SPECTRAL_INDICES = {
    "ndvi": ("nir", "red"),
    "ndwi": ("green", "nir"),
    "ndmi": ("nir", "swir16"),
    "mndwi": ("green", "swir16"),
}


def spectral_indices(df: DataFrame, specs: Mapping[str, tuple[str, str]] = SPECTRAL_INDICES) -> DataFrame:
    present = {n: p for n, p in specs.items() if has(df, *p)}
    return df.withColumns({n: normalized_difference(F.col(a), F.col(b)) for n, (a, b) in present.items()})


def band_ratios(df: DataFrame) -> DataFrame:
    out: dict[str, Column] = {}
    if has(df, "red", "green"):
        out["turbidity"] = F.col("red") / (F.col("green") + F.lit(EPS))
    if has(df, "nir", "red"):
        out["chlorophyll"] = F.col("nir") / (F.col("red") + F.lit(EPS))
    if has(df, "red", "nir", "swir16", "green"):
        bright, dark = F.col("swir16") + F.col("red"), F.col("nir") + F.col("green")
        out["bare_soil"] = (bright - dark) / (bright + dark + F.lit(EPS))
    return df.withColumns(out) if out else df


def log_nonneg(c: Column) -> Column:
    """log1p of a column clipped at zero; null stays null."""
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def interaction_features(df: DataFrame) -> DataFrame:
    """Products and ratios of whichever source columns are present."""
    out: dict[str, Column] = {}
    if has(df, "elevation"):
        out["log_elevation"] = log_nonneg(F.col("elevation"))
    if has(df, "dam_distance"):
        out["log_dam_distance"] = log_nonneg(F.col("dam_distance"))
    # Product features.
    products = {
        "elev_x_slope": ("elevation", "slope"),
        "elev_x_rain": ("elevation", "rain_30d"),
        "crop_x_rain": ("cropland", "rain_30d"),
        "urban_x_rain": ("urban", "rain_30d"),
        "karst_x_rain": ("karst", "rain_30d"),
    }
    for name, (a, b) in products.items():
        if has(df, a, b):
            out[name] = F.col(a) * F.col(b)
    if has(df, "rain_7d", "rain_30d"):
        out["rain_ratio"] = F.col("rain_7d") / (F.col("rain_30d") + F.lit(EPS))
    if has(df, "cropland"):
        cover = lambda *names: sum((F.col(c) for c in names if has(df, c)), F.lit(0.0))
        out["natural_ratio"] = cover("tree", "shrub", "grass") / (cover("cropland", "urban", "bare") + F.lit(EPS))
    return df.withColumns(out) if out else df


# --- keys, units, flags ----------------------------------------------------------------------


def key_normalize(df: DataFrame, cols: Sequence[str], places: int = 4) -> DataFrame:
    """Floating keys to fixed places (half-even); every other key to trimmed text."""
    types = dict(df.dtypes)
    fix = lambda c: F.bround(F.col(c), places) if types[c] in ("double", "float") else F.trim(F.col(c).cast("string"))
    return df.withColumns({c: fix(c) for c in cols})


def coord_key(lat: Column, lon: Column, places: int = 4) -> Column:
    """One text key per rounded coordinate."""
    scale = F.lit(float(10**places))
    return F.concat_ws("_", F.bround(lat * scale).cast("bigint"), F.bround(lon * scale).cast("bigint"))


def composite_key(*cols: Column) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def unit_convert(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") * F.lit(float(f)) for c, f in factors.items()})


def coverage_flag(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """1 when any column with the prefix holds a value."""
    cols = [F.col(c).cast("string") for c in df.columns if c.startswith(prefix)]
    flag = F.coalesce(*cols).isNotNull().cast("int") if cols else F.lit(0)
    return df.withColumn(name, flag)


NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def select_features(df: DataFrame, drop: Sequence[str] = (), prefixes: Sequence[str] = ()) -> list[str]:
    """Numeric columns outside ``drop``; with ``prefixes`` only those starting with one of them."""
    names = [c for c, t in df.dtypes if t in NUMERIC_TYPES and c not in set(drop)]
    return [c for c in names if c.startswith(tuple(prefixes))] if prefixes else names


def sanitize(c: Column, fill_missing: bool = False) -> Column:
    """Infinities become 0; missing becomes 0 only for learners that cannot take it."""
    inf = F.lit(float("inf"))
    finite = F.when(F.abs(c) == inf, F.lit(0.0)).otherwise(F.nanvl(c, F.lit(None).cast("double")))
    return F.coalesce(finite, F.lit(0.0)) if fill_missing else finite


def clip_prediction(p: Column, ceiling: Column | None = None) -> Column:
    low = F.when(p < 0, F.lit(0.0)).otherwise(p)
    return low if ceiling is None else F.when(low > ceiling, ceiling).otherwise(low)


# --- transforms ------------------------------------------------------------------------------


def target_transform(c: Column, method: str) -> Column:
    base = F.when(c < 0, F.lit(0.0)).otherwise(c)
    if method == "log1p":
        return F.log1p(base)
    if method == "shifted_log":
        return F.log1p(base + F.lit(1.0))
    if method == "none":
        return c
    raise ValueError(f"unknown transform {method!r}")


def target_inverse(c: Column, method: str) -> Column:
    if method == "log1p":
        return F.expm1(c)
    if method == "shifted_log":
        return F.expm1(c) - F.lit(1.0)
    if method == "none":
        return c
    raise ValueError(f"unknown transform {method!r}")


def yeo_johnson(c: Column, lam: Column | float) -> Column:
    lam = F.lit(float(lam)) if not isinstance(lam, Column) else lam
    up = F.when(F.abs(lam) < 1e-12, F.log1p(F.abs(c))).otherwise(
        (F.pow(F.abs(c) + 1.0, lam) - 1.0) / F.when(F.abs(lam) < 1e-12, F.lit(1.0)).otherwise(lam)
    )
    mirror = F.lit(2.0) - lam
    down = F.when(F.abs(mirror) < 1e-12, -F.log1p(F.abs(c))).otherwise(
        -(F.pow(F.abs(c) + 1.0, mirror) - 1.0) / F.when(F.abs(mirror) < 1e-12, F.lit(1.0)).otherwise(mirror)
    )
    return F.when(c >= 0, up).otherwise(down)


def yeo_johnson_inverse(c: Column, lam: float) -> Column:
    size = F.abs(c)
    if abs(lam) < 1e-12:
        up = F.expm1(size)
    else:
        up = F.pow(size * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    mirror = 2.0 - lam
    if abs(mirror) < 1e-12:
        down = -F.expm1(size)
    else:
        down = 1.0 - F.pow(size * mirror + 1.0, F.lit(1.0 / mirror))
    return F.when(c >= 0, up).otherwise(down)


def stable_sigmoid(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


# Lithology name -> class code (1 is carbonate).
LITHOLOGY_CODES = {
    0: ("sedimentary", "sedimentary rocks", "shale", "sandstone", "mudstone", "siltstone"),
    1: ("limestone", "carbonate", "dolomite", "chalk"),
    2: ("metamorphic", "metamorphic rocks", "gneiss", "schist", "quartzite", "marble"),
    3: ("igneous", "igneous rocks", "volcanic", "volcanic rocks", "granite", "basalt", "dolerite", "gabbro", "rhyolite"),
    4: ("unconsolidated", "alluvium", "sand", "gravel", "clay", "till"),
}


def category_code(c: Column, codes: Mapping[int, Sequence[str]] = LITHOLOGY_CODES) -> Column:
    """Class code of a trimmed, lower-cased name; -1 for anything not listed."""
    name = F.lower(F.trim(c))
    out = F.lit(-1)
    for code, names in codes.items():
        out = F.when(name.isin(*names), F.lit(code)).otherwise(out)
    return out


# --- distances -------------------------------------------------------------------------------


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat1 - lat2) / 2.0)
    half_lon = F.sin(F.radians(lon1 - lon2) / 2.0)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
