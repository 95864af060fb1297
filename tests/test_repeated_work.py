"""Work that is done once, however many copies there are or plans that read it."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import knn, partition
from plumbline.plans import catalogue

XY = ["x", "y"]


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("flat", [(), (("x", "qx"), ("y", "qy"))])
def test_brute_force_looks_at_copies_once(spark, monkeypatch, include_self, flat):
    seen = []

    def top(pairs, *more):
        seen.append(pairs.count())
        return whole(pairs, *more)

    whole = knn._top
    monkeypatch.setattr(knn, "_top", top)
    p = spark.range(20000).select(F.col("id").alias("nid"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    q = p.filter("nid % 50 = 0").select(F.col("nid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    got = {}
    for r in knn.brute(p, q, 3, G.dist2(G.cols(XY), [F.col("qx"), F.col("qy")]), include_self, flat).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["nid"], r["dist2"]))
    assert len(got) == 400 and max(seen) <= 35 * 35 * 4
    for qid, found in got.items():
        equal = [i for i in range(qid % 35, 20000, 35) if include_self or i != qid][:3]
        assert sorted(found) == [(i, nid, 0.0) for i, nid in enumerate(equal, 1)]


def test_brute_force_ranks_nulls_last(spark):
    p = spark.createDataFrame([(1, None, 0.0), (2, 5.0, 0.0), (3, 1.0, 0.0)], "nid long, x double, y double")
    q = spark.createDataFrame([(1, 0.0, 0.0)], "qid long, qx double, qy double")
    for flat in ((), (("x", "qx"), ("y", "qy"))):
        got = knn.brute(p, q, 3, G.dist2(G.cols(XY), [F.col("qx"), F.col("qy")]), True, flat).collect()
        assert sorted((r["rank"], r["nid"], r["dist2"]) for r in got) == [(1, 3, 1.0), (2, 2, 25.0), (3, 1, None)]


def part(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("p_partkey"), (F.col("id") * 37 % 50).cast("int").alias("p_size"), (F.col("id") * 53 % 997).cast("double").alias("p_retailprice"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_a_delete_is_evaluated_once_for_a_search(spark, tmp_path, monkeypatch):
    d, seen = part(spark, tmp_path), []
    monkeypatch.setattr(knn, "pruned", lambda f, *more: seen.append(f) or f.points)
    catalogue.queries()["knn_after_delete"](spark, d)
    plan = seen[0].points._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert seen[0].points.count() == 1500


def test_rebalancing_counts_no_leaf_anew(spark, monkeypatch):
    known = []

    def learn(points, dims, leaves, *more, n=None):
        known.append((n, points.count()))
        return whole(points, dims, leaves, *more, n=n)

    p = spark.range(2000).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    f = partition.SpatialFrame.build(p, XY, 4)
    whole = partition.learn_splits
    monkeypatch.setattr(partition, "learn_splits", learn)
    assert f.rebalance(100).stats().agg(F.sum("n")).first()[0] == 2000
    assert known and all(n == counted for n, counted in known)
