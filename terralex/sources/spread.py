"""Spreading documents over the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by a unique key into ``spark.sql.shuffle.partitions`` parts.

    Splits follow bytes, and a file with one row group is one task whatever its rows cost later.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
