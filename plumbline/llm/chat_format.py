"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets a rendering in which that speaker is the assistant and all others are named users;
system turns stay system turns for all. The mask lists where, in code points of the rendering, the assistant's own words
and their end mark stand: what a model is to learn.

The turns of a dialogue are numbered in their order, and a rendering comes in parts of ``MOST`` turns: part p holds turns
``MOST * p`` on. So a dialogue of up to ``MOST`` turns is rendered in one piece, and a part is the largest thing that one task
gathers, whatever the turns' own numbers are. The parts in order make up the dialogue; positions count within a part.
Dialogues of more than one part are numbered in one range-partitioned sort of their distinct rows, each with its count, so
neither a hot dialogue nor equal rows meet in a task; that is another way to the same rows.

Defined results: turns go by number (null first), then role, then text; equal rows are kept, all of them; a null role is a
speaker named ``unknown``; a null text is empty; dialogues without a participant (only system turns) give no rows; other
columns are ignored. No text can be told from the marks it may hold; the masks, not the marks, say what is whose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

#: Turns of a part, and tasks that the parts of one dialogue are dealt to.
MOST, DEALT = 1024, 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = ("system",)
UNKNOWN = "unknown"


def _in_parts(t: DataFrame) -> DataFrame:
    """Each distinct row once for every part of its dialogue that it has places in, with the number of these as ``copies``."""
    order = ["turn", "role", "text"]
    rows = t.groupBy("conv_id", *order).agg(F.count(F.lit(1)).alias("n"))
    ranges = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the bounds of ranges are drawn by sampling and a second evaluation could draw others
    rows = cut(rows.repartitionByRange(ranges, "conv_id", *order).withColumn("__s", F.spark_partition_id()))
    rows = rows.withColumn("__within", F.sum("n").over(Window.partitionBy("__s", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    # a dialogue has at most one row a range here
    ahead = rows.groupBy("__s", "conv_id").agg(F.sum("n").alias("n"))
    ahead = ahead.withColumn("__before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ahead = small_side(ahead.select(F.col("__s").alias("__r"), F.col("conv_id").alias("__c"), "__before"))
    rows = rows.join(ahead, (F.col("__s") == F.col("__r")) & F.col("conv_id").eqNullSafe(F.col("__c")))
    rows = rows.withColumn("__from", F.col("__before") + F.col("__within")).withColumn("__to", F.col("__from") + F.col("n"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("__from") / MOST), F.floor((F.col("__to") - 1) / MOST))))
    copies = F.least("__to", (F.col("part") + 1) * MOST) - F.greatest("__from", F.col("part") * MOST)
    return rows.select("conv_id", "part", *order, copies.cast("int").alias("copies"))


def _crowded_parts(t: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """The parts of dialogues of more than ``MOST`` turns, once for each speaker of the whole dialogue."""
    gathered = _in_parts(t).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns"))
    repeated = F.flatten(F.transform("turns", lambda x: F.array_repeat(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")), x["copies"])))
    speakers = t.filter(~F.col("role").isin(*system)).select(F.col("conv_id").alias("__c"), F.col("role").alias("perspective")).distinct()
    # parts of one dialogue are dealt to several tasks, each of which gets its speakers
    dealt = speakers.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("__d"))
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.pmod("part", F.lit(DEALT)) == F.col("__d"))
    return gathered.withColumn("turns", repeated).join(dealt, same).select("conv_id", "perspective", "part", "turns")


def render(turns: DataFrame, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, perspective, part, n_turns, text, mask (``start:end`` by commas)."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # dialogues of more than one part are rare: they are counted first, and only their keys are joined back
    crowded = cut(t.groupBy(F.col("conv_id").alias("__c")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > MOST).select("__c"))
    usual, many = t, None
    if crowded.limit(1).count():
        keys, same = small_side(crowded), F.col("conv_id").eqNullSafe(F.col("__c"))
        usual, many = t.join(keys, same, "left_anti"), t.join(keys, same, "left_semi")
    whole = usual.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_except(F.transform("turns", lambda x: x["role"]), F.array(*[F.lit(x) for x in system]).cast("array<string>"))
    seen = whole.select("conv_id", F.explode(speakers).alias("perspective"), F.lit(0).cast("long").alias("part"), "turns")
    if many is not None:
        seen = seen.unionByName(_crowded_parts(many, system))

    def head(x):
        own = x["role"] == F.col("perspective")
        return F.concat(F.lit(OPEN), F.when(x["role"].isin(*system), x["role"]).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), x["role"])), F.lit("\n"))

    def add(a, x):
        start = a["at"] + F.length(head(x))
        end = start + F.length(x["text"]) + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), (end - 1).cast("string"))
        own = x["role"] == F.col("perspective")
        return F.struct(end.cast("int").alias("at"), F.when(own, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return seen.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(head(x), x["text"], F.lit(CLOSE))), "").alias("text"),
        F.array_join(F.aggregate("turns", start, add, lambda a: a["spans"]), ",").alias("mask"),
    )
