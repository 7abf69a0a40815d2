"""Writing and reading word vectors as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vector_line(word: Column, vec: Column) -> Column:
    """``word v1 … vD`` at six decimals."""
    return F.concat_ws(" ", word.cast("string"), F.concat_ws(" ", F.transform(vec, lambda x: F.format_string("%.6f", x))))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write (word_id, word, vec): a vocabulary table and the vector lines, in many files."""
    vectors.select("word_id", "word").write.mode("overwrite").parquet(f"{path}/vocab")
    lines = vectors.sort("word_id").select(vector_line(F.col("word"), F.col("vec")).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/lines")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`save_vectors` wrote, ids attached by word."""
    parts = F.split("value", " ")
    lines = spark.read.text(f"{path}/lines").select(
        parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec")
    )
    return spark.read.parquet(f"{path}/vocab").join(lines, "word").select("word_id", "word", "vec")
