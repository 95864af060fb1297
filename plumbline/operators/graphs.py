"""Edge tables (u, v[, w]) and what can be made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import cut, numbered


def dedup(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Without loops, both directions, each once."""
    e = edges.filter("u <> v").select("u", "v")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def add_weights(edges: DataFrame, seed: int = 1) -> DataFrame:
    """A weight in [0, 1) from the hash of the edge."""
    return edges.withColumn("w", F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(1 << 53)) / float(1 << 53))


def shuffled(edges: DataFrame, seed: int = 1) -> DataFrame:
    """In the order of a seeded hash."""
    return edges.orderBy(F.xxhash64(F.lit(seed), *edges.columns), *edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))


def vertex_count(edges: DataFrame) -> DataFrame:
    """One more than the largest id; 0 for no edges."""
    return edges.agg(F.coalesce(F.greatest(F.max("u"), F.max("v")) + 1, F.lit(0)).alias("n"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(u, offset, degree) of vertices with edges in the order of ids: exclusive sums of the degrees, by ranges of ids."""
    # written, as the bounds of ranges are drawn by sampling and a second evaluation could draw others
    d = cut(degrees(edges).repartitionByRange("u").withColumn("__p", F.spark_partition_id()))
    inside = F.sum("degree").over(Window.partitionBy("__p").orderBy("u").rowsBetween(Window.unboundedPreceding, -1))
    sums = d.groupBy("__p").agg(F.sum("degree").alias("__s"))
    before = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    rows = d.withColumn("__i", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__p")
    return rows.select("u", (F.col("__b") + F.col("__i")).alias("offset"), "degree")


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, neighbours): sorted lists, for graphs whose degrees fit a row."""
    return edges.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))


def edges_of(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("neighbours").alias("v"))


def relabelled(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Ids replaced by a permutation (old, new)."""
    a = permutation.select(F.col("old").alias("u"), F.col("new").alias("nu"))
    b = permutation.select(F.col("old").alias("v"), F.col("new").alias("nv"))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), *rest)


def random_permutation(vertices: DataFrame, seed: int = 1) -> DataFrame:
    """(old, new) in the order of a seeded hash; ``vertices`` has ``old``."""
    return numbered(vertices.withColumn("__h", F.xxhash64(F.lit(seed), "old")), ["__h", "old"], "new").select("old", "new")


def consistency(edges: DataFrame, n: int) -> DataFrame:
    """One row: edges, those with an end outside 0..n-1, and whether degrees add up to the edges."""
    outside = F.sum(F.when((F.col("u") < 0) | (F.col("u") >= n) | (F.col("v") < 0) | (F.col("v") >= n), 1).otherwise(0))
    total = degrees(edges).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("degree_sum"))
    return edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(outside, F.lit(0)).alias("outside")).join(total).withColumn("holds", (F.col("degree_sum") == F.col("m")) & (F.col("outside") == 0))


def edge_map(frontier: DataFrame, edges: DataFrame, condition: Column | None = None) -> DataFrame:
    """The next frontier: targets of edges from the frontier that meet a condition on u, v and edge columns, each once."""
    reached = edges.join(frontier.select("u").distinct(), "u")
    return (reached if condition is None else reached.filter(condition)).select(F.col("v").alias("u")).distinct()


def breadth_first(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(u, level) of all vertices within ``most`` steps of the start."""
    seen = start.select("u").distinct().withColumn("level", F.lit(0))
    frontier = seen.select("u")
    for level in range(1, most + 1):
        frontier = edge_map(frontier, edges).join(seen.select("u"), "u", "left_anti")
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    return seen


def first_reservations(bids: DataFrame) -> DataFrame:
    """(item, cell) -> the items that hold every cell they bid for, where the least item wins a cell: one round."""
    winners = bids.groupBy("cell").agg(F.min("item").alias("winner"))
    return bids.join(winners, "cell").groupBy("item").agg(F.bool_and(F.col("item") == F.col("winner")).alias("holds")).filter("holds").select("item")
