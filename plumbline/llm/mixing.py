"""Mixing sources to target weights.

Sizes are summed by source (partial sums first, so a source with a third of all rows costs no more than others), targets
are found on that small table by a water-filling rule, and every document is then taken ``floor(rate)`` times, plus once
more with probability equal to the rest of the rate. The draw is a hash of the row and a seed: reruns agree, and so does
any task that is run again. No Python runs on the executors.

Defined results: a null text has size 0; a null source is a source of its own and comes last; an empty table gives an
empty table; equal rows with equal ids draw alike; columns besides those named are ignored by ``mix`` and kept by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_side, text_or_empty

#: Weights in turn of the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17

#: Hexadecimal digits of the hash that make the draw: 52 bits, exact as a double.
DRAW_DIGITS = 13


def size_of(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def draw(seed: int, doc_id: Column, source: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the row and the seed alone."""
    row = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), F.md5(text_or_empty(text).cast("binary")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("double") / float(16**DRAW_DIGITS)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    ``weights`` go round over the sources by code point, null last. A target is ``min(level * weight, cap * size)`` with
    the level that spends ``share`` of all sizes: sources in order of the level at which they fill, running sums of
    their caps and of the weights still open give every candidate level, and the right one is the first that fills no
    further source. That is where sharing the excess again and again ends. The windows run over one row a source.
    """
    first = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(first) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("full_at", F.col("limit") / F.col("weight"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    t = t.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct(F.col("full_at"), F.col("level")))).over(everything)["level"]
    return t.select("source", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"))


def _rated(docs: DataFrame, weights: tuple, share: float, cap: float, seed: int, keep: list[Column]) -> DataFrame:
    source = F.col("source").cast("string")
    rows = docs.select(*keep, source.alias("__source"), size_of(F.col("text")).alias("__size"), draw(seed, F.col("doc_id"), source, F.col("text")).alias("__draw"))
    sizes = docs.groupBy(source.alias("source")).agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    plan = small_side(targets(sizes, weights, share, cap).select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("__s")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return rows.withColumn("__copies", (whole + F.when(F.col("__draw") < rate - whole, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target (its source's), taken and copies."""
    return _rated(docs, weights, share, cap, seed, [F.col("doc_id")]).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"),
    )


def emit(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = _rated(docs, weights, share, cap, seed, [keep]).filter("__copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select("__row.*")
