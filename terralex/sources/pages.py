"""Reading facts out of scraped pages and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extract_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Every ``href="…"`` value in page order."""
    found = F.regexp_extract_all(F.col(html_col), F.lit('(?i)href="([^"]+)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("pos", "href"))


def pair_links(links: DataFrame, id_col: str, marker: Column, target: Column) -> DataFrame:
    """Give each target link the nearest marker link before it; a marker serves one target only.

    A marker is taken by the first target after it. ``marker`` wins where both match. A page's
    links come out of one page cell, which bounds the window.
    """
    order = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_marker = F.coalesce(marker, F.lit(False))
    is_target = F.coalesce(target, F.lit(False)) & ~is_marker
    tagged = links.withColumn("_mark", F.when(is_marker, F.struct("pos", "href"))).withColumn(
        "_tgt", F.when(is_target, F.col("pos"))
    )
    seen = tagged.withColumn("_m", F.last("_mark", ignorenulls=True).over(order)).withColumn(
        "_t", F.last("_tgt", ignorenulls=True).over(order)
    )
    free = F.col("_m").isNotNull() & (F.col("_t").isNull() | (F.col("_m.pos") > F.col("_t")))
    return seen.filter(F.col("_tgt").isNotNull() & free).select(
        id_col, "pos", F.col("href").alias("target"), F.col("_m.href").alias("marker")
    )


def absolute_link(link: Column, prefix: str) -> Column:
    """A relative link gets the prefix, its leading dots and slashes dropped."""
    return F.when(link.startswith("http"), link).otherwise(
        F.concat(F.lit(prefix), F.regexp_replace(link, "^[./]+", ""))
    )


def file_name(link: Column, old_suffix: str, new_suffix: str) -> Column:
    return F.replace(F.substring_index(link, "/", -1), F.lit(old_suffix), F.lit(new_suffix))


def extract_coordinates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Signed decimals after the words latitude and longitude, kept inside the bounding box."""
    number = lambda word: F.regexp_extract(F.col(text_col), rf"(?i){word}\s+(-?\d+\.?\d*)", 1).try_cast("double")
    got = docs.select(id_col, number("latitude").alias("lat"), number("longitude").alias("lon"))
    # The box coordinates must lie in.
    return got.filter((F.col("lat") > -36) & (F.col("lat") < -20) & (F.col("lon") > 16) & (F.col("lon") < 34))
