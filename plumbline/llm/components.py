"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds after which something must be wrong: stars at least halve the longest path.
MOST_ROUNDS = 60


#: Edges are sampled, one in so many, for nodes that very many point to; of these at most so many are broadcast.
SAMPLE, HOT = 16, 1000
#: Up to so many edges, as counted, are tied within one task, as rounds over so few cost more in jobs than in work.
ALONE = 500_000
#: Rows of an Arrow batch that is returned.
BATCH = 10_000


def _pointed(e: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) of n, tied to the least node that v points to, or v itself if it points to none.

    Nodes that very many point to are guessed from a sample and looked up in a broadcast table, as their edges would meet in
    one task of the join. A wrong guess costs time, not edges.
    """
    found = e.filter(F.pmod(F.xxhash64("u"), F.lit(SAMPLE)) == 0).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    hot = F.broadcast(found.filter(F.col("c") > max(n // (SAMPLE * HOT), 4)).select(F.col("v").alias("__v")))
    known = least.join(hot, F.col("u") == F.col("__v"), "left_semi").select(F.col("u").alias("__u"), "m")
    table = F.broadcast(hot.join(F.broadcast(known), F.col("__v") == F.col("__u"), "left").select("__v", F.col("m").alias("__m")))
    rows = e.join(table, F.col("v") == F.col("__v"), "left")
    usual = rows.filter("__v is null").select("u", "v").join(least.select(F.col("u").alias("__u"), "m"), F.col("v") == F.col("__u"), "left")
    return usual.unionByName(rows.filter("__v is not null").select("u", "v", F.col("__m").alias("m"), F.col("__v").alias("__u"))).select("u", F.coalesce("m", "v").alias("v"))


def least_linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes is linked to over any steps by edges (u, v)."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) -> (node, root)."""
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    found = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends, nodes = place[found.indices.to_numpy()], found.dictionary.take(pa.array(order))
    root = least_linked(ends[: edges.num_rows], ends[edges.num_rows :], len(order))
    for i in range(0, len(order), BATCH):
        yield pa.RecordBatch.from_arrays([nodes[i : i + BATCH], nodes.take(pa.array(root[i : i + BATCH]))], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the least node of the component. Nodes without an edge do not appear.

    Up to ``ALONE`` edges are tied in one task. Beyond that, edges run from the greater node u to the less one v. In each
    round every edge is tied to the least node that its v points to, then all that a node points to are tied to the least of
    these, until all hang on roots (large and small stars).
    Minima are pre-aggregated, no neighbourhood is collected, and each round is written to the shared checkpoint folder.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark is None and now[0] <= ALONE:
            kind = e.schema["u"].dataType.simpleString()
            return e.coalesce(1).mapInArrow(_tied, f"node {kind}, root {kind}")
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
        large = _pointed(e, e.groupBy("u").agg(F.min("v").alias("m")), now[0]).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
    raise RuntimeError("components did not settle")
