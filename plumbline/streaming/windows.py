"""Sliding windows over batches, and maintenance of a point set from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(rows: DataFrame, batch: str, width: int, last: int) -> DataFrame:
    """Every row with each window (``w``, up to ``last``) that holds it: window w is the batches w - width + 1 to w. Rows of
    later batches are in none."""
    rows = rows.filter(F.col(batch) <= last)
    return rows.withColumn("w", F.explode(F.sequence(F.col(batch), F.least(F.col(batch) + width - 1, F.lit(last)))))


def last_batch(rows: DataFrame, batch: str) -> int:
    """The latest batch; -1 for no rows, where no window holds anything."""
    last = rows.agg(F.max(batch)).first()[0]
    return -1 if last is None else int(last)


def window_stats(rows: DataFrame, batch: str, width: int, last: int, stats: Sequence[Column]) -> DataFrame:
    """Aggregates by window, for aggregates that may be taken by batch first (count, sum, min, max) use ``merged``."""
    return held(rows, batch, width, last).groupBy("w").agg(*stats)


def merged(rows: DataFrame, batch: str, width: int, last: int, dims: Sequence[str]) -> DataFrame:
    """Counts and boxes by window from one row a batch: the rows themselves are aggregated once."""
    parts = [x for c in dims for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    by_batch = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *parts)
    ends = [x for c in dims for x in (F.min(f"lo_{c}").alias(f"lo_{c}"), F.max(f"hi_{c}").alias(f"hi_{c}"))]
    return held(by_batch, batch, width, last).groupBy("w").agg(F.sum("n").alias("n"), *ends)


def stream_counts(stream: DataFrame, ts: str, width: str, slide: str, late: str) -> DataFrame:
    """Counts by sliding event-time window; state older than the watermark goes."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def maintain(stream: DataFrame, path: str, batch: str, checkpoint: str):
    """A query that adds each micro-batch to a Parquet point set once, however often it is retried: a batch has a folder of its own."""

    def put(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{batch}={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark, path: str, batch: str, width: int) -> DataFrame:
    """The rows of the last ``width`` batches; older folders are pruned, not read."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(batch)).first()[0]
    return rows.filter(F.col(batch) > last - width)
