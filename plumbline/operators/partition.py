"""Spatial partitioning: kd splits learned from a bounded sample, leaves as a column, zone maps as a small table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G

#: Sampled points that each leaf's splits rest on, and the most leaves that splits are learned for at once.
SAMPLE_A_LEAF, MOST_LEAVES = 16, 4096
#: The rows of a leaf that a search aims at, the most leaves that it refines a frame to, and the points that it samples for
#: that and for bounds: a fourth of all up to this many, or what the leaves' splits rest on.
LEAF_ROWS, FINEST, BOUNDING = 256, 32768, 1 << 18
#: Up to so many rows are dealt anew to all cores before they meet a broadcast table.
DEALT = 4_000_000
#: Trees up to this depth are nested CASEs, of which a row takes one path; deeper ones are walked through literal arrays.
CASE_DEPTH = 9


@dataclass
class Splits:
    """A binary tree of (dimension, value): below the value goes left. Nodes are numbered from 1, children 2n and 2n+1."""

    dims: list[str]
    nodes: dict[int, tuple[int, float]] = field(default_factory=dict)

    def depth(self) -> int:
        return max((n.bit_length() for n in self.nodes), default=0)

    def leaf(self) -> Column:
        """The leaf that a point falls in, as the number of its node."""
        if self.depth() <= CASE_DEPTH:
            return self._case(1)
        size = 1 << self.depth()
        dim = F.array(*[F.lit(self.nodes[i][0] if i in self.nodes else -1) for i in range(size)])
        value = F.array(*[F.lit(float(self.nodes[i][1]) if i in self.nodes else 0.0) for i in range(size)])
        point = F.array(*[F.col(c).cast("double") for c in self.dims])

        def step(at: Column, _: Column) -> Column:
            place = F.least(at, F.lit(size - 1)).cast("int") + 1
            axis = F.when(at < size, F.element_at(dim, place)).otherwise(-1)
            right = F.element_at(point, F.greatest(axis, F.lit(0)) + 1) >= F.element_at(value, place)
            return F.when(axis < 0, at).otherwise(2 * at + right.cast("long"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth())), F.lit(1).cast("long"), step)

    def assign(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds the leaf as a column. Deep trees are walked by batches, a level at a time."""
        return rows.withColumn(name, self.leaf() if self.depth() <= 4 else self._walk())

    def _walk(self) -> Column:
        walk = self.walker()

        def leaves(*columns: pa.Array) -> pa.Array:
            return pa.array(walk(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)))

        # not to be evaluated once more in a filter on the leaf
        return F.arrow_udf(leaves, "long").asNondeterministic()(*[F.col(c).cast("double") for c in self.dims])

    def walker(self) -> Callable[[np.ndarray], np.ndarray]:
        """The leaves of points, a row a point."""
        place = {node: i for i, node in enumerate(self.nodes)}
        dim = np.array([d for d, _ in self.nodes.values()], dtype=np.int64)
        value = np.array([float(v) for _, v in self.nodes.values()])
        left, right = (np.array([place.get(2 * n + side, -(2 * n + side)) for n in self.nodes], dtype=np.int64) for side in (0, 1))
        root, depth = place.get(1, -1), self.depth()

        def walk(point: np.ndarray) -> np.ndarray:
            row = np.arange(len(point))
            at = np.full(len(point), root, dtype=np.int64)
            for _ in range(depth):
                here = np.maximum(at, 0)
                at = np.where(at < 0, at, np.where(point[row, dim[here]] < value[here], left[here], right[here]))
            return -at

        return walk

    def node_count(self) -> int:
        """Inner nodes and leaves: every split has two nodes below it."""
        return 2 * len(self.nodes) + 1

    def out_of_turn(self) -> list[int]:
        """The nodes whose split is not over the dimension whose turn it is at their depth."""
        return sorted(node for node, (d, _) in self.nodes.items() if d != (node.bit_length() - 1) % len(self.dims))

    def cells(self) -> list[tuple]:
        """(leaf, from, to, from, to, ...) of every leaf: the part of space below and from the values of the nodes above it."""
        out = []
        stack = [(1, [(float("-inf"), float("inf"))] * len(self.dims))]
        while stack:
            node, box = stack.pop()
            if node not in self.nodes:
                out.append((node, *[x for side in box for x in side]))
                continue
            d, v = self.nodes[node]
            low, high = box[d]
            stack += [(2 * node, [*box[:d], (low, float(v)), *box[d + 1 :]]), (2 * node + 1, [*box[:d], (float(v), high), *box[d + 1 :]])]
        return out

    def _case(self, node: int) -> Column:
        if node not in self.nodes:
            return F.lit(node).cast("long")
        d, v = self.nodes[node]
        return F.when(F.col(self.dims[d]) < v, self._case(2 * node)).otherwise(self._case(2 * node + 1))


def learn_splits(points: DataFrame, dims: Sequence[str], leaves: int, rule: str = "max_stretch", seed: int = 11, n: int | None = None) -> Splits:
    """Medians of a bounded hash sample, level by level, until there are about ``leaves`` leaves.

    ``max_stretch`` cuts the longest side of a node's box, ``rotate`` the dimensions in turn. Where the median leaves
    nothing on the left, the least greater value is the split; where a dimension is constant, another is taken; where all
    points are equal, the node stays a leaf. Answers never depend on the splits, only their spread does. ``n`` is the count
    of points, if it is known.
    """
    leaves = min(leaves, MOST_LEAVES)
    want = leaves * SAMPLE_A_LEAF
    out = Splits(list(dims))
    level = [(1, _sample(points, dims, points.count() if n is None else n, want, seed))]
    for depth in range(max(0, math.ceil(math.log2(max(leaves, 1))))):
        following = []
        for node, rows in level:
            following += _halved(out.nodes, node, rows, depth, rule)
        level = following
    return out


def _sample(points: DataFrame, dims: Sequence[str], n: int, want: int, seed: int = 11) -> np.ndarray:
    """About ``want`` of ``n`` points, at most twice as many, chosen by hash: a row a point."""
    parts = 1 << 40
    drawn = F.pmod(F.xxhash64(F.lit(seed), *dims), F.lit(parts))
    copies = F.pmod(F.xxhash64(F.lit(seed + 1), *points.columns), F.lit(parts))
    kept = points if n <= want else points.filter(copies < parts * want // n)
    found = kept.select(*[F.col(c).cast("double").alias(c) for c in dims], drawn.alias("__u")).orderBy("__u", *dims).limit(2 * want).select(*dims).toArrow()
    return np.stack([found.column(i).to_numpy() for i in range(len(dims))], axis=1)


def _halved(nodes: dict, node: int, rows: np.ndarray, depth: int, rule: str) -> list[tuple]:
    """Puts a node's split, if it has one, and returns its two nodes with their rows."""
    cut = _cut(rows, depth, rule)
    if cut is None:
        return []
    d, v = nodes[node] = cut
    low = rows[:, d] < v
    return [(2 * node, rows[low]), (2 * node + 1, rows[~low])]


def _cut(rows: np.ndarray, depth: int, rule: str) -> tuple[int, float] | None:
    if len(rows) < 2:
        return None
    d = rows.shape[1]
    sides = (rows.max(axis=0) - rows.min(axis=0)).tolist()
    order = sorted(range(d), key=lambda k: -sides[k]) if rule == "max_stretch" else [(depth + k) % d for k in range(d)]
    for k in order:
        if sides[k] > 0:
            values = np.sort(rows[:, k])
            middle = values[len(values) // 2]
            return k, float(middle if middle > values[0] else values[np.searchsorted(values, middle, "right")])
    return None


def dealt(points: DataFrame, n: int) -> DataFrame:
    """A table of few rows may be one range of a file; it is dealt to all cores."""
    return points.repartition(points.sparkSession.sparkContext.defaultParallelism) if n <= DEALT else points


def zone_map(points: DataFrame, dims: Sequence[str], leaf: str = "leaf_id") -> DataFrame:
    """One row a leaf: its count, box and depth."""
    boxes = [f(F.col(c)).alias(f"{side}_{c}") for c in dims for side, f in (("lo", F.min), ("hi", F.max))]
    stats = points.groupBy(leaf).agg(F.count(F.lit(1)).alias("n"), *boxes)
    return stats.withColumn("depth", F.floor(F.log2(F.col(leaf).cast("double"))).cast("int"))


@dataclass
class SpatialFrame:
    """A bag of points with the leaf of each and the zone map of the leaves. Operations return new frames."""

    points: DataFrame
    dims: list[str]
    splits: Splits
    #: Some of the points, of a frame that was refined.
    sample: np.ndarray | None = None

    @classmethod
    def build(cls, points: DataFrame, dims: Sequence[str], leaves: int = 64, rule: str = "max_stretch") -> SpatialFrame:
        splits = learn_splits(points, dims, leaves, rule)
        return cls(splits.assign(points, "leaf_id"), list(dims), splits)

    @classmethod
    def unsplit(cls, points: DataFrame, dims: Sequence[str]) -> SpatialFrame:
        """One leaf, for searches, which refine it."""
        return cls(points.withColumn("leaf_id", F.lit(1).cast("long")), list(dims), Splits(list(dims)))

    def refined(self, rows: int = LEAF_ROWS, n: int | None = None) -> SpatialFrame:
        """The same tree with splits below its leaves until these hold about ``rows`` rows, for searches; at most about
        ``FINEST`` leaves. What is below a leaf is learned from a bounded sample. ``n`` is the count of points, if it is known."""
        n = self.points.count() if n is None else n
        leaves = min(FINEST, math.ceil(n / rows))
        if leaves <= 1:
            return self
        nodes = dict(self.splits.nodes)
        bare = self.points.drop("leaf_id")
        sample = _sample(bare, self.dims, n, max(leaves * SAMPLE_A_LEAF, min(n // 4, BOUNDING)))
        stack = [(1, sample)]
        while stack:
            node, found = stack.pop()
            if node in nodes:
                d, v = nodes[node]
                low = found[:, d] < v
                stack += [(2 * node, found[low]), (2 * node + 1, found[~low])]
            elif len(found) > 1.5 * len(sample) / leaves and node.bit_length() < 60:
                stack += _halved(nodes, node, found, node.bit_length() - 1, "max_stretch")
        if len(nodes) == len(self.splits.nodes):
            return SpatialFrame(self.points, self.dims, self.splits, sample)
        splits = Splits(self.dims, nodes)
        return SpatialFrame(splits.assign(bare, "leaf_id"), self.dims, splits, sample)

    def stats(self) -> DataFrame:
        return zone_map(self.points, self.dims)

    def bbox(self) -> DataFrame:
        return bounding_box(self.points, self.dims)

    def clustered(self, partitions: int | None = None) -> SpatialFrame:
        """Rows of a leaf in one partition and file range, so that Parquet's own minima and maxima prune scans."""
        moved = self.points.repartitionByRange(partitions, "leaf_id") if partitions else self.points.repartitionByRange("leaf_id")
        return SpatialFrame(moved.sortWithinPartitions("leaf_id", *self.dims), self.dims, self.splits)

    def insert(self, batch: DataFrame) -> SpatialFrame:
        """Bag union; only the batch is assigned to leaves."""
        return SpatialFrame(self.points.unionByName(self.splits.assign(batch, "leaf_id")), self.dims, self.splits)

    def delete(self, batch: DataFrame, key: Sequence[str]) -> SpatialFrame:
        """Bag difference on ``key``: one stored row goes for each requested one; requests without a row do nothing."""
        from plumbline.operators.mutate import delete_with_payload

        return SpatialFrame(delete_with_payload(self.points, batch, key), self.dims, self.splits)

    def settled(self) -> SpatialFrame:
        """The same frame with its points written to the checkpoint folder: leaves are stored and lineage ends."""
        from plumbline.operators.ordering import cut

        return SpatialFrame(cut(self.points), self.dims, self.splits)

    def rebalance(self, capacity: int) -> SpatialFrame:
        """Splits leaves that hold more than ``capacity`` rows anew; the others keep their rows and numbers."""
        nodes = dict(self.splits.nodes)
        over = self.stats().filter(F.col("n") > capacity).select("leaf_id", "n").orderBy("leaf_id").limit(MOST_LEAVES).collect()
        for leaf, n in over:
            inside = self.points.filter(F.col("leaf_id") == leaf).drop("leaf_id")
            below = learn_splits(inside, self.dims, max(2, math.ceil(n / capacity)), n=n)
            for node, cut in below.nodes.items():
                depth = node.bit_length() - 1
                nodes[(leaf << depth) + (node - (1 << depth))] = cut
        splits = Splits(self.dims, nodes)
        return SpatialFrame(splits.assign(self.points.drop("leaf_id"), "leaf_id"), self.dims, splits)

    def validate(self) -> DataFrame:
        """One row: sizes add up, and the box around each leaf's points lies in the cell that the splits give that leaf (a leaf
        number that the splits don't have fails), so every point is where a search looks for it. Cells are below their upper
        ends and from their lower ends on; they follow from the splits alone, not from the expression that assigns points."""
        s = self.stats()
        cells = s.sparkSession.createDataFrame(self.splits.cells(), "__leaf long, " + ", ".join(f"__from_{c} double, __to_{c} double" for c in self.dims))
        inside = F.lit(True)
        for c in self.dims:
            inside = inside & (F.col(f"lo_{c}") >= F.col(f"__from_{c}")) & ((F.col(f"hi_{c}") < F.col(f"__to_{c}")) | (F.col(f"__to_{c}") == float("inf")))
        s = s.join(F.broadcast(cells), F.col("leaf_id") == F.col("__leaf"), "left")
        total = s.agg(
            F.sum("n").alias("n_in_leaves"), F.count(F.lit(1)).alias("leaves"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"),
            F.coalesce(F.bool_and(F.col("__leaf").isNotNull() & F.coalesce(inside, F.lit(False))), F.lit(True)).alias("leaves_hold"),
        )
        rows = self.points.agg(F.count(F.lit(1)).alias("n_points"))
        return rows.join(total).select("n_points", "n_in_leaves", "leaves", "max_depth", "mean_depth", "leaves_hold", (F.col("n_points") == F.coalesce("n_in_leaves", F.lit(0))).alias("sizes_hold"))


def bounding_box(points: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The closed box around the points, by group if asked; null for none."""
    boxes = [f(F.col(c)).alias(f"{side}_{c}") for c in dims for side, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*by).agg(*boxes)


def exact_split(points: DataFrame, dims: Sequence[str], levels: int) -> DataFrame:
    """Diagnostic kd splits at exact medians, dimensions in turn: adds ``node``.

    A level numbers the rows once to find the medians of its nodes, at most 2 ** level small rows that are joined back.
    """
    from plumbline.operators.ordering import value_at_rank

    rows = points.withColumn("node", F.lit(1).cast("long"))
    for level in range(levels):
        c = dims[level % len(dims)]
        middle = value_at_rank(rows, "node", c, lambda n: F.floor(n / 2)).select(F.col("node").alias("__node"), F.col(c).alias("__m"))
        beside = rows.join(F.broadcast(middle), F.col("node") == F.col("__node"))
        ends = beside.groupBy("node").agg(F.first("__m").alias("__m"), F.min(c).alias("__l"), F.min(F.when(F.col(c) > F.col("__m"), F.col(c))).alias("__above"))
        at = F.when(F.col("__m") > F.col("__l"), F.col("__m")).otherwise(F.coalesce("__above", "__m"))
        rows = rows.join(F.broadcast(ends.select(F.col("node").alias("__node"), at.alias("__v"))), F.col("node") == F.col("__node"), "left")
        rows = rows.withColumn("node", 2 * F.col("node") + F.when(F.col(c) < F.col("__v"), 0).otherwise(1)).drop("__node", "__v")
    return rows


def zorder(points: DataFrame, dims: Sequence[str], bits: int | None = None) -> DataFrame:
    """Adds the Morton key ``z``: cells of one global scale from the table's own box, which is one small row."""
    bits = bits or G.morton_bits(len(dims))
    box = bounding_box(points, dims).first()
    if box is None or box[0] is None:
        return points.withColumn("z", F.lit(None).cast("long"))
    lows = [float(box[f"lo_{c}"]) for c in dims]
    side = max(float(box[f"hi_{c}"]) - lo for c, lo in zip(dims, lows, strict=True))
    return points.withColumn("z", G.morton([G.cell(F.col(c), F.lit(lo), F.lit(side), bits) for c, lo in zip(dims, lows, strict=True)], bits))


def by_zorder(points: DataFrame, dims: Sequence[str], partitions: int, bits: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by Morton key."""
    return zorder(points, dims, bits).repartitionByRange(partitions, "z").sortWithinPartitions("z", *dims)
