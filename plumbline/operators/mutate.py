"""Bag union and bag difference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert(points: DataFrame, batch: DataFrame) -> DataFrame:
    return points.unionByName(batch)


def delete(points: DataFrame, batch: DataFrame) -> DataFrame:
    """One stored copy goes for each requested copy; absent ones are ignored. Counts by row, so copies cost nothing."""
    return points.exceptAll(batch.select(*points.columns))


def found(points: DataFrame, batch: DataFrame) -> DataFrame:
    """The requested copies that are stored."""
    return points.intersectAll(batch.select(*points.columns))


def delete_with_payload(points: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Bag difference on ``key`` that keeps the other columns: of equal keys the first by ``order`` go.

    Requests are counted first; only keys with a request are numbered, so a hot key without one is never sorted.
    """
    asked = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("__asked"))
    on = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key])
    rows = points.alias("p").join(asked.alias("a"), on, "left").select("p.*", "a.__asked")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*(order or [c for c in points.columns if c not in key] or list(key))))
    kept = rows.filter("__asked is not null").withColumn("__r", number).filter("__r > __asked")
    return rows.filter("__asked is null").select(*points.columns).unionByName(kept.select(*points.columns))


def delete_checked(points: DataFrame, batch: DataFrame) -> DataFrame:
    """As ``delete``, but fails if a requested copy is not stored."""
    missing = batch.select(*points.columns).exceptAll(points).limit(1).count()
    if missing:
        raise ValueError("the batch asks for points that are not stored")
    return delete(points, batch)


def first_rows(points: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by a total order."""
    return points.orderBy(*order).limit(n)
