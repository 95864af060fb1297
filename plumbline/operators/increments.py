"""Point sets that grow or shrink step by step. Every step is written, so lineage does not grow with the steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import numbered
from plumbline.operators.partition import SpatialFrame


def grown(points: DataFrame, dims: Sequence[str], slice_of: Column, slices: int, every: int = 1, leaves: int = 64) -> Iterator[tuple[int, SpatialFrame]]:
    """(step, frame) after each ``every`` steps. The rows of slice 0 are built, those of the slices 1, 2, ... inserted one after
    the other; ``slice_of`` is over the points. Splits stay those of the first slice, answers do not depend on them."""
    frame = SpatialFrame.build(points.filter(slice_of == 0), dims, leaves)
    for step in range(1, slices + 1):
        if step > 1:
            frame = frame.insert(points.filter(slice_of == step - 1)).settled()
        if step % every == 0:
            yield step, frame


def by_steps(frame: SpatialFrame, batch: DataFrame, order: Sequence[str], step: int, most: int, key: Sequence[str] | None = None) -> Iterator[tuple[int, SpatialFrame]]:
    """(step, frame) after each run of ``step`` rows of the batch, of which the first ``most`` in a total ``order`` are taken.

    They are inserted, or with a ``key`` deleted as a bag. The batch is numbered and written once.
    """
    if step < 1:
        raise ValueError("a step has at least one row")
    rows = numbered(batch, order, "__i")
    for k, low in enumerate(range(0, most, step), 1):
        part = rows.filter((F.col("__i") >= low) & (F.col("__i") < min(low + step, most))).drop("__i")
        frame = (frame.delete(part, key) if key else frame.insert(part)).settled()
        yield k, frame
