"""Total orders at scale."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` holds the partition above so many bits and the row's place in it below.
PLACE_BITS = 33


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder that the cluster names. A local session, as in tests, may go without; a cluster may not."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "i", partitions: int | None = None) -> DataFrame:
    """Adds the place of each row in a total order, from 0, without bringing all rows to one task.

    Rows are range-partitioned and sorted once, and written with partition and place: bounds of ranges are drawn by
    sampling, so a second evaluation could draw others. One row a partition carries the offsets.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = cut(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    placed = moved.withColumn("__p", F.shiftright("__m", PLACE_BITS)).withColumn("__r", F.col("__m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__before") + F.col("__r")).drop("__m", "__p", "__r", "__before")


def value_at_rank(rows: DataFrame, by: str, value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """(by, value, n): of each group's values in order the one at ``rank(n)``, from 0; groups must be few, their rows may be many.

    Rows are numbered in one order over all groups, and each group looks its place up; no group is gathered in a task.
    """
    rows = rows.filter(F.col(value).isNotNull())
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.select(F.col(by).alias("__by"), "n", (before + rank(F.col("n"))).alias("__at"))
    at = numbered(rows.select(by, value), [by, value], "__i")
    return at.join(F.broadcast(wanted), F.col("__i") == F.col("__at")).select(by, value, "n")
