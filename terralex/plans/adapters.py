"""Views that give the driver's tables the shapes the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.sources.spread import spread

TARGETS = ("target_a", "target_b", "target_c")
AUX = ("aux_1", "aux_2")

# Event type -> observation column.
EVENT_COLUMNS = {"purchase": "target_a", "view": "target_b", "click": "target_c", "error": "aux_1", "signup": "aux_2"}


class Tables:
    """Lazily built views over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stations(self) -> DataFrame:
        s = F.col("user_id")
        return (
            self.read("events")
            .select("user_id")
            .distinct()
            .select(
                s.alias("station"),
                (s % 5).alias("region"),
                (F.lit(-34.0) + ((s * 37) % 1000) / F.lit(100.0)).alias("lat"),
                (F.lit(17.0) + ((s * 91) % 1500) / F.lit(100.0)).alias("lon"),
            )
        )

    def observations(self) -> DataFrame:
        """One row per station and day; the pivot is a plain aggregate, combined map-side."""
        pick = [F.max(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for e, c in EVENT_COLUMNS.items()]
        return (
            self.read("events")
            .groupBy(F.col("user_id").alias("station"), F.col("ts").cast("date").alias("day"))
            .agg(*pick)
        )

    def samples(self) -> DataFrame:
        """Every order as a dated point: a third on a station, a third beside one, a third away."""
        orders, stations = self.read("orders"), self.stations()
        size = self.read("events").agg((F.max("user_id") + 1).alias("n")).scalar()
        key = F.col("o_orderkey")
        shift = F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 0.003).otherwise(0.3)
        return (
            orders.withColumn("station", F.col("o_custkey") % size)
            .join(stations, "station")
            .select(
                key.alias("sample_id"),
                (F.col("lat") + shift).alias("lat"),
                "lon",
                F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).alias("day"),
                F.col("o_totalprice").alias("target_a"),
            )
        )

    def placed(self) -> DataFrame:
        """Samples with the station their order maps to, for the operators that start from one."""
        size = self.read("events").agg((F.max("user_id") + 1).alias("n")).scalar()
        return (
            self.read("orders")
            .select(
                F.col("o_orderkey").alias("sample_id"),
                (F.col("o_custkey") % size).alias("station"),
                F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("day"),
            )
        )

    def pois(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.read("customer").select(
            c.alias("poi_id"),
            (F.lit(-34.0) + ((c * 53) % 1000) / F.lit(100.0)).alias("lat"),
            (F.lit(17.0) + ((c * 29) % 1500) / F.lit(100.0)).alias("lon"),
            F.col("c_mktsegment").alias("tag"),
        )

    def predictions(self) -> DataFrame:
        bias = F.lit(0.9) + F.lit(0.02) * ((F.col("station") * 13 + F.dayofmonth("day")) % 10)
        return (
            self.observations()
            .filter(F.col("target_a").isNotNull())
            .select("station", "day", F.col("target_a").alias("truth"), (F.col("target_a") * bias).alias("pred"))
        )

    def daily_weather(self) -> DataFrame:
        exact = lambda e: F.sum(F.when(F.col("event_type") == e, F.col("value").cast("decimal(18,2)"))).cast("double")
        return (
            self.read("events")
            .groupBy(F.col("user_id").alias("loc_id"), F.col("ts").cast("date").alias("day"))
            .agg(exact("purchase").alias("rain"), exact("view").alias("et"))
        )

    def pixels(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("loc_id"), F.posexplode("embedding").alias("i", "v")
        ).select(
            "loc_id", F.expr("CAST(i DIV 8 AS INT)").alias("y"), F.expr("CAST(i % 8 AS INT)").alias("x"),
            F.col("v").cast("double").alias("value"),
        )

    def links(self) -> DataFrame:
        from terralex.sources.pages import extract_links

        return extract_links(self.read("pages"), "page_id", "html")

    def corpus(self) -> DataFrame:
        from terralex.operators.text import tokenize

        docs = self.read("documents").select("doc_id", "text")
        return tokenize(spread(docs, "doc_id"), "doc_id", "text")


SQL_VIEWS = {
    "stations": """SELECT DISTINCT user_id AS station, user_id % 5 AS region,
       -34e0 + ((user_id * 37) % 1000) / 1e2 AS lat, 17e0 + ((user_id * 91) % 1500) / 1e2 AS lon FROM events""",
    "observations": """SELECT user_id AS station, CAST(ts AS DATE) AS day,
       max(CASE WHEN event_type = 'purchase' THEN value END) AS target_a,
       max(CASE WHEN event_type = 'view' THEN value END) AS target_b,
       max(CASE WHEN event_type = 'click' THEN value END) AS target_c,
       max(CASE WHEN event_type = 'error' THEN value END) AS aux_1,
       max(CASE WHEN event_type = 'signup' THEN value END) AS aux_2
       FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "samples": """SELECT o.o_orderkey AS sample_id,
       s.lat + CASE o.o_orderkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 3e-3 ELSE 3e-1 END AS lat,
       s.lon AS lon, DATE '2024-01-01' + CAST(o.o_orderkey % 30 AS INT) AS day, o.o_totalprice AS target_a
       FROM orders o JOIN stations s ON s.station = o.o_custkey % (SELECT 1 + max(user_id) FROM events)""",
    "placed": """SELECT o_orderkey AS sample_id, o_custkey % (SELECT 1 + max(user_id) FROM events) AS station,
       DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS day FROM orders""",
    "pois": """SELECT c_custkey AS poi_id, -34e0 + ((c_custkey * 53) % 1000) / 1e2 AS lat,
       17e0 + ((c_custkey * 29) % 1500) / 1e2 AS lon, c_mktsegment AS tag FROM customer""",
    "predictions": """SELECT station, day, target_a AS truth,
       target_a * (9e-1 + 2e-2 * ((station * 13 + day(day)) % 10)) AS pred
       FROM observations WHERE target_a IS NOT NULL""",
    "daily_weather": """SELECT user_id AS loc_id, CAST(ts AS DATE) AS day,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS rain,
       CAST(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS et
       FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "pixels": """SELECT vec_id AS loc_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
       CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(64)) AS i) t""",
    "corpus": """SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
       FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents)""",
    "links": """SELECT page_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS href
       FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS w FROM pages)""",
}

_NEEDS = {"samples": ("stations",), "predictions": ("observations",)}


def ctes(*views: str, **extra: str) -> str:
    """``WITH`` list for the named views and what they need, in order."""
    if not views:
        return ""
    names: list[str] = []
    for v in views:
        for need in (*_NEEDS.get(v, ()), v):
            if need not in names:
                names.append(need)
    body = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {body}\n"
