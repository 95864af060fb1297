"""Searches of leaves by Arrow batches in numpy: bounds, leaves within reach, and neighbours among a leaf's points.

Distances sum squares over the dimensions in order, as ``functions.geometry`` does, so bounds never contradict distances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Boxes below one of the next level, boxes at the top, and pairs of a place and a point or box that are looked at in one step.
FAN, TOP, STEP_PAIRS = 8, 16, 1 << 21
#: Points and places that are compared at once when all pairs are, so that their distances stay in a core's cache.
BLOCK_POINTS, BLOCK_PLACES = 2048, 16
#: Points that are searched at once where all places are at hand, and those of a box there.
CHUNK, RUN = 1 << 18, 64
#: Rows of an Arrow batch that is returned.
BATCH = 10_000


def points_of(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """A row a point; null is NaN."""
    out = np.empty((batch.num_rows, len(names)))
    for i, c in enumerate(names):
        column = batch.column(c)
        out[:, i] = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
    return out


def aligned(nodes: np.ndarray) -> np.ndarray:
    """Numbers of nodes, shifted to one length: those below a node follow each other. Answers don't depend on it."""
    length = np.frexp(nodes.astype(np.float64))[1].astype(np.int64)
    # rounding up to a power of two would give one bit more
    length -= (nodes >> np.minimum(length - 1, 62)) == 0
    return nodes << np.maximum(62 - length, 0)


def bounder(walk: Callable[[np.ndarray], np.ndarray], sample: np.ndarray, names: Sequence[str], need: int, window: int) -> Callable:
    """Adds ``reach`` to places: the squared distance of the ``need``-th of ``window`` sampled points about the place's leaf."""
    leaf = walk(sample) if len(sample) else np.zeros(0, dtype=np.int64)
    key = aligned(leaf)
    order = np.argsort(key, kind="stable")
    key, sample = key[order], sample[order]
    window = min(len(sample), max(window, need))
    schema = pa.schema([*[(c, pa.float64()) for c in names], ("reach", pa.float64())])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = points_of(batch, names)
            reach = np.full(len(at), np.inf)
            if window >= need:
                home = aligned(walk(at))
                middle = (np.searchsorted(key, home, "left") + np.searchsorted(key, home, "right")) // 2
                first = np.clip(middle - window // 2, 0, len(sample) - window)
                step = max(1, STEP_PAIRS // window)
                for i in range(0, len(at), step):
                    near = first[i : i + step, None] + np.arange(window)
                    d = np.zeros(near.shape)
                    for c in range(at.shape[1]):
                        gap = sample[near, c] - at[i : i + step, c, None]
                        d += gap * gap
                    reach[i : i + step] = np.partition(d, need - 1, axis=1)[:, need - 1]
                reach[np.isnan(reach)] = np.inf
            yield pa.RecordBatch.from_arrays([*[pa.array(at[:, c]) for c in range(at.shape[1])], pa.array(reach)], schema=schema)

    return bound


def _levels(lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of leaves that follow each other in the tree, boxes of these, and so on up to a few."""
    out = [(lo, hi)]
    while len(out[-1][0]) > TOP:
        lo, hi = out[-1]
        starts = np.arange(0, len(lo), FAN)
        out.append((np.fmin.reduceat(lo, starts, axis=0), np.fmax.reduceat(hi, starts, axis=0)))
    return out


def visitor(stats: pa.Table, dims: Sequence[str], names: Sequence[str]) -> Callable:
    """(leaf_id, reach, the place, __at): the leaves whose boxes come within reach of each place."""
    leaf = stats.column("leaf_id").to_numpy()
    order = np.argsort(aligned(leaf)) if len(leaf) else np.zeros(0, dtype=np.int64)
    leaf = leaf[order]
    levels = _levels(points_of(stats, [f"lo_{c}" for c in dims])[order], points_of(stats, [f"hi_{c}" for c in dims])[order]) if len(leaf) else []
    schema = pa.schema([("leaf_id", pa.int64()), ("reach", pa.float64()), *[(c, pa.float64()) for c in names], ("__at", pa.int64())])

    def met(at: np.ndarray, reach: np.ndarray, place: np.ndarray, box: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs within reach, in steps of bounded size."""
        lo, hi = levels[level]
        kept = []
        for i in range(0, len(place), STEP_PAIRS):
            p, b = place[i : i + STEP_PAIRS], box[i : i + STEP_PAIRS]
            d = np.zeros(len(p))
            for c in range(at.shape[1]):
                x = at[p, c]
                gap = np.maximum(np.maximum(lo[b, c] - x, x - hi[b, c]), 0.0)
                d += gap * gap
            near = d <= reach[p]
            kept.append((p[near], b[near]))
        return np.concatenate([p for p, _ in kept]), np.concatenate([b for _, b in kept])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            at, reach = points_of(batch, names), batch.column("reach").to_numpy(zero_copy_only=False)
            if not levels or not len(at):
                continue
            top = len(levels[-1][0])
            place, box = met(at, reach, np.repeat(np.arange(len(at)), top), np.tile(np.arange(top), len(at)), len(levels) - 1)
            for level in range(len(levels) - 2, -1, -1):
                size = len(levels[level][0])
                below = (box[:, None] * FAN + np.arange(FAN)).ravel()
                place = np.repeat(place, FAN)
                place, box = place[below < size], below[below < size]
                if not len(place):
                    break
                place, box = met(at, reach, place, box, level)
            for i in range(0, len(place), BATCH):
                p, b = place[i : i + BATCH], box[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[b]), pa.array(reach[p]), *[pa.array(at[p, c]) for c in range(at.shape[1])], pa.array(number + p)], schema=schema)
            number += len(at)

    return visit


def parts(stats: pa.Table, most: int) -> np.ndarray:
    """A part for each leaf: leaves that follow each other in the tree and have about ``most`` rows together."""
    leaf, n = stats.column("leaf_id").to_numpy(), stats.column("n").to_numpy()
    out = np.zeros(len(leaf), dtype=np.int64)
    order = np.argsort(aligned(leaf)) if len(leaf) else out
    ends = np.cumsum(n[order])
    out[order] = (ends - n[order]) // max(1, most)
    return out


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy()
    return pc.rank(ids.combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _without_copies(leaf: np.ndarray, p: np.ndarray, rank: np.ndarray, need: int) -> np.ndarray:
    """The order of points by leaf, place and rank, without those that have ``need`` copies of less rank in their leaf."""
    order = np.lexsort((rank, *p.T, leaf))
    leaf, p = leaf[order], p[order]
    new = np.ones(len(leaf), dtype=bool)
    new[1:] = (leaf[1:] != leaf[:-1]) | (p[1:] != p[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return order[np.arange(len(leaf)) - np.repeat(starts, np.diff(np.append(starts, len(leaf)))) < need]


def searcher(dims: Sequence[str], names: Sequence[str], need: int, near: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of points and visits of a part: each place with its ``need`` nearest in the leaves that it visits, ties by id.

    Points that have ``need`` copies of less id are left out first, as no answer holds them.
    """
    schema = pa.schema([*[(c, pa.float64()) for c in names], ("__near", pa.list_(near))])

    def search(points: pa.Table, visits: pa.Table) -> pa.Table:
        if not points.num_rows or not visits.num_rows:
            return schema.empty_table()
        leaf, p, rank = points.column("leaf_id").to_numpy(), points_of(points, dims), _ranks(points.column("nid"))
        order = _without_copies(leaf, p, rank, need)
        leaf, p, rank = leaf[order], p[order], rank[order]

        _, first, place = np.unique(visits.column("__at").to_numpy(), return_index=True, return_inverse=True)
        v_leaf, q, reach = visits.column("leaf").to_numpy(), points_of(visits, names), visits.column("reach").to_numpy()
        asked = np.argsort(v_leaf, kind="stable")
        leaves, begin = np.unique(v_leaf[asked], return_index=True)
        end = np.append(begin[1:], len(asked))
        lows, highs = np.searchsorted(leaf, leaves, "left"), np.searchsorted(leaf, leaves, "right")
        within = np.full(len(first), np.inf)
        found = []
        for low, high, b, e in zip(lows.tolist(), highs.tolist(), begin.tolist(), end.tolist(), strict=True):
            size = high - low
            if not size:
                continue
            step = max(1, STEP_PAIRS // size)
            for i in range(b, e, step):
                v = asked[i : min(e, i + step)]
                who = place[v]
                d = np.zeros((len(v), size))
                for c in range(q.shape[1]):
                    gap = p[low:high, c] - q[v, c, None]
                    d += gap * gap
                # a place visits a leaf once, so no place is twice in who
                most = np.fmin(reach[v], within[who])
                if size >= need:
                    most = np.fmin(most, np.partition(d, need - 1, axis=1)[:, need - 1])
                within[who] = most
                row, col = np.nonzero(d <= most[:, None])
                found.append((who[row], d[row, col], col + low))
        who, d, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
        close = d <= within[who]
        who, d, at = who[close], d[close], at[close]
        nearest = np.lexsort((rank[at], d, who))
        who, d, at = who[nearest], d[nearest], at[nearest]
        begin = np.searchsorted(who, np.arange(len(first)))
        kept = np.arange(len(who)) - begin[who] < need
        who, d, at = who[kept], d[kept], at[kept]
        offsets = np.append(0, np.cumsum(np.bincount(who, minlength=len(first)))).astype(np.int32)
        ids = points.column("nid").combine_chunks().take(pa.array(order[at]))
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d), ids], names=["dist2", "nid"]).cast(near))
        return pa.table([*[pa.array(q[first, c]) for c in range(q.shape[1])], lists.cast(pa.list_(near))], schema=schema)

    return search


def nearby(walk: Callable[[np.ndarray], np.ndarray], places: pa.Table, dims: Sequence[str], names: Sequence[str], need: int, near: pa.DataType) -> Callable:
    """Of points with ``nid``, chunk by chunk: each place with its ``need`` nearest of the chunk within reach, ties by id.

    ``places`` has ``names`` and reach. A chunk is put in the order of the tree that ``walk`` goes down, and boxes around runs
    of it tell which points a place looks at.
    """
    seek = searcher(dims, names, need, near)

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pa.Table.from_batches(held)
        p = points_of(points, dims)
        order = _without_copies(aligned(walk(p)), p, _ranks(points.column("nid")), need)
        p = p[order]
        starts = np.arange(0, len(order), RUN)
        run = np.arange(len(order)) // RUN + (1 << 40)  # numbers of one length
        lo, hi = np.fmin.reduceat(p, starts, axis=0), np.fmax.reduceat(p, starts, axis=0)
        boxes = {"leaf_id": run[starts]} | {f"{side}_{c}": ends[:, i] for i, c in enumerate(dims) for side, ends in (("lo", lo), ("hi", hi))}
        visits = list(visitor(pa.table(boxes), dims, names)(iter(places.to_batches())))
        if visits:
            visits = pa.Table.from_batches(visits).rename_columns(["leaf", "reach", *names, "__at"])
            near = seek(points.take(pa.array(order)).append_column("leaf_id", pa.array(run)), visits)
            yield from near.filter(pc.greater(pc.list_value_length(near.column("__near")), 0)).to_batches(BATCH)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from found(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from found(held)

    return look


def comparer(places: pa.Table, flat: Sequence[tuple[str, str]]) -> Callable:
    """(qid, nid, dist2) of points with ``nid``: all pairs within ``reach`` of the places, or with a null where it is infinite.

    ``flat`` names the columns of points and places whose squared differences add up to the distance.
    """
    q, reach = points_of(places, [b for _, b in flat]), places.column("reach").to_numpy()
    qid = places.column("qid").combine_chunks()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, total = np.empty((BLOCK_PLACES, BLOCK_POINTS)), np.empty((BLOCK_PLACES, BLOCK_POINTS))
        for batch in batches:
            p, nid = points_of(batch, [a for a, _ in flat]), batch.column("nid")
            for i in range(0, len(p), BLOCK_POINTS):
                at = np.ascontiguousarray(p[i : i + BLOCK_POINTS].T)
                found = []
                for j in range(0, len(q), BLOCK_PLACES):
                    who = q[j : j + BLOCK_PLACES]
                    g, d = gap[: len(who), : at.shape[1]], total[: len(who), : at.shape[1]]
                    for c in range(len(flat)):
                        np.subtract(at[c], who[:, c, None], out=g)
                        if c:
                            np.multiply(g, g, out=g)
                            np.add(d, g, out=d)
                        else:
                            np.multiply(g, g, out=d)
                    most = reach[j : j + BLOCK_PLACES, None]
                    hit = np.flatnonzero(((d <= most) | np.isinf(most)) if np.isinf(most).any() else (d <= most))
                    if len(hit):
                        found.append((j + hit // at.shape[1], i + hit % at.shape[1], d.ravel()[hit] if d.flags.c_contiguous else d[hit // at.shape[1], hit % at.shape[1]]))
                if found:
                    who, to, d = (np.concatenate([f[x] for f in found]) for x in range(3))
                    for b in range(0, len(who), BATCH):
                        s = slice(b, b + BATCH)
                        yield pa.RecordBatch.from_arrays([qid.take(pa.array(who[s])), nid.take(pa.array(to[s])), pa.array(d[s], from_pandas=True)], names=["qid", "nid", "dist2"])

    return compare
