"""Seeded point generators and cleaning of raw point files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(spark: SparkSession, n: int, d: int, most: int = 1_000_000, least: int = 0, seed: int = 1) -> DataFrame:
    """(id, x0, ...): whole numbers from ``least`` to ``most``, the same for the same seed however many tasks run."""
    span = most - least + 1
    return spark.range(n).select("id", *[(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(span)) + least).cast("double").alias(f"x{k}") for k in range(d)])


def random_index(least: int, below: int, *of: str, seed: int = 1) -> Column:
    """A whole number from ``least`` on and less than ``below``, told by some columns: 52 bits of a digest that any engine has."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *of)), 1, 13), 16, 10).cast("long") / float(1 << 52)
    return F.floor(drawn * (below - least)).cast("long") + least


def clustered(spark: SparkSession, n: int, d: int, clusters: int = 20, most: int = 100_000, seed: int = 1) -> DataFrame:
    """Points of varying density: each falls towards a seeded centre by a power of a uniform draw."""
    def unit(*parts):
        return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / float(1 << 53)

    c = F.pmod(F.xxhash64(F.lit(seed), F.lit("c"), "id"), F.lit(clusters))
    reach = F.pow(unit(F.lit("r"), "id"), 3) * most / 2
    return spark.range(n).select("id", *[F.least(F.greatest(F.round(unit(F.lit("m"), c, F.lit(k)) * most + (unit(F.lit("o"), F.lit(k), "id") - 0.5) * reach), F.lit(0.0)), F.lit(float(most))).alias(f"x{k}") for k in range(d)])


def random_walks(spark: SparkSession, walks: int, steps: int, d: int, seed: int = 1) -> DataFrame:
    """Seeded walks, each a running sum of small steps: dense along paths, sparse elsewhere."""
    rows = spark.range(walks).select(F.col("id").alias("walk"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    along = Window.partitionBy("walk").orderBy("step")
    move = [F.sum(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "walk", F.when(F.col("step") == 0, -1).otherwise(F.col("step"))), F.when(F.col("step") == 0, 100_000).otherwise(21)) - F.when(F.col("step") == 0, 0).otherwise(10)).over(along).cast("double").alias(f"x{k}") for k in range(d)]
    return rows.select("walk", "step", *move)


def washed(lines: DataFrame) -> DataFrame:
    """Repeated spaces are one, and every row but the header loses its first column."""
    clean = F.regexp_replace(F.trim("value"), r"\s+", " ")
    return lines.select(F.when(F.size(F.split(clean, " ")) == 2, clean).otherwise(F.regexp_replace(clean, r"^\S+ ", "")).alias("value"))


def by_period(nodes: DataFrame, start: str, end: str) -> DataFrame:
    """(id, ts, lon, lat) -> distinct rows of a time slice with year and month, for ``write.partitionBy``."""
    ts = F.to_timestamp("ts")
    return nodes.dropDuplicates().withColumn("ts", ts).filter(F.col("ts").between(F.lit(start), F.lit(end))).select("ts", "lon", "lat", F.year("ts").alias("year"), F.month("ts").alias("month"))


def boxes_around(points: DataFrame, dims: list[str], size: int, order: list[str]) -> DataFrame:
    """Query boxes (qid, qlo_x, qhi_x): each spans ``size`` successive points of a total order."""
    from plumbline.operators.ordering import numbered

    rows = numbered(points, order).withColumn("qid", F.floor(F.col("i") / size))
    return rows.groupBy("qid").agg(*[x for c in dims for x in (F.min(c).alias(f"qlo_{c}"), F.max(c).alias(f"qhi_{c}"))])


def shifted_queries(points: DataFrame, dims: list[str], widths: float, n: int, seed: int = 1) -> DataFrame:
    """Uniform queries (qid, x...) in the data's box moved by ``widths`` times its sides."""
    box = points.agg(*[x for c in dims for x in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))])
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "qid"), F.lit(1 << 53)) / float(1 << 53)
    rows = points.sparkSession.range(n).select(F.col("id").alias("qid")).join(F.broadcast(box))
    return rows.select("qid", *[(F.col(f"lo_{c}") + (F.lit(float(widths)) + u(k)) * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c) for k, c in enumerate(dims)])
