"""Components of few edges are tied in one task, those of many by rounds; both give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components as C


def test_few_edges_need_no_rounds(spark, monkeypatch):
    def round_(*_):
        raise AssertionError("a round over few edges")

    monkeypatch.setattr(C, "_pointed", round_)
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert set(map(tuple, C.components(e).collect())) == {(i, 0) for i in range(301)}


@pytest.mark.parametrize("kind", ["binary", "string", "long"])
def test_both_ways_agree(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    name = {"binary": lambda i: bytearray([i * 37 % 256, i // 256]), "string": lambda i: f"ä{i * 37 % 256}", "long": lambda i: int(i) * 37 % 256 - 99}[kind]
    e = spark.createDataFrame([(name(i), name(j)) for i, j in rng.integers(0, 250, (120, 2))], f"a {kind}, b {kind}")
    few = sorted(map(tuple, C.components(e).collect()))
    monkeypatch.setattr(C, "ALONE", -1)
    assert few and few == sorted(map(tuple, C.components(e).collect()))
    assert C.components(e.limit(0)).count() == 0
    monkeypatch.undo()
    assert C.components(e.limit(0)).count() == 0
