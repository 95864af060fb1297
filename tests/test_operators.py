"""Edge cases and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import graphs, increments, knn, meshes, mutate, partition, ranges
from plumbline.operators.ordering import numbered, value_at_rank
from plumbline.operators.partition import SpatialFrame
from plumbline.sources import generators, text_formats
from plumbline.streaming import windows

SCHEMA = "id long, x double, y double"


def frame(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], SCHEMA)


def brute(rows, q, k):
    d = sorted(((x - q[0]) ** 2 + (y - q[1]) ** 2, i) for i, (x, y) in enumerate(rows))
    return d[:k]


FIXTURES = {
    "all_same": [(1, 1)] * 100,
    "const_dim": [(5, y) for y in range(1, 101)],
    "dup_median": [(3, 3)] * 80 + [(i, i) for i in range(20)],
    "few": [(0, 0), (1, 1), (2, 2)],
    "negatives": [(random.Random(1).uniform(-5, 5), random.Random(i).uniform(-5, 5)) for i in range(90)],
}


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("rule", ["max_stretch", "rotate"])
def test_knn_is_exact_on_any_layout(spark, name, rule):
    rows = FIXTURES[name]
    f = SpatialFrame.build(frame(spark, rows), ["x", "y"], 8, rule)
    q = spark.createDataFrame([(0, 1.0, 1.0), (1, 4.0, -2.0)], "qid long, x double, y double")
    got = knn.pruned(f, q, 10, "id").orderBy("qid", "rank").collect()
    for qid, point in ((0, (1, 1)), (1, (4, -2))):
        assert [(r["dist2"], r["nid"]) for r in got if r["qid"] == qid] == brute(rows, point, 10)
    assert f.validate().first()["sizes_hold"]


def test_empty_set(spark):
    f = SpatialFrame.build(frame(spark, []), ["x", "y"])
    q = spark.createDataFrame([(0, 1.0, 1.0)], "qid long, x double, y double")
    assert knn.pruned(f, q, 3, "id").count() == 0
    assert f.bbox().first()["lo_x"] is None
    boxes = q.select("qid", F.lit(0.0).alias("qlo_x"), F.lit(2.0).alias("qhi_x"), F.lit(0.0).alias("qlo_y"), F.lit(2.0).alias("qhi_y"))
    assert ranges.count_pruned(f, boxes).first()["n"] == 0


def test_closed_borders(spark):
    p = frame(spark, [(3, 4), (0, 5), (3.0001, 4), (0, 0)])
    ball = spark.createDataFrame([(0, 0.0, 0.0, 5.0)], "qid long, c_x double, c_y double, radius double")
    assert ranges.count_in(p, ["x", "y"], ball, "ball").first()["n"] == 3
    box = spark.createDataFrame([(0, 0.0, 3.0, 4.0, 5.0)], "qid long, qlo_x double, qhi_x double, qlo_y double, qhi_y double")
    assert ranges.count_in(p, ["x", "y"], box).first()["n"] == 2


def test_pruned_ranges_match_plain_ones(spark):
    rows = [(random.Random(i).gauss(0, 5), random.Random(-i).gauss(0, 5)) for i in range(500)]
    p = frame(spark, rows)
    boxes = ranges.pair_boxes(p, ["x", "y"], ["id"], 40)
    f = SpatialFrame.build(p, ["x", "y"], 16)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ranges.count_pruned(f, boxes)) == key(ranges.count_in(p, ["x", "y"], boxes))
    assert key(ranges.report_pruned(f, boxes).drop("leaf_id")) == key(ranges.report_in(p, ["x", "y"], boxes))


def test_bag_delete(spark):
    a, b, c = (1, 1), (2, 2), (9, 9)
    stored = frame(spark, [a, a, a, b]).select("x", "y")
    batch = frame(spark, [a, a, c]).select("x", "y")
    assert sorted(map(tuple, mutate.delete(stored, batch).collect())) == [(1.0, 1.0), (2.0, 2.0)]
    assert sorted(map(tuple, mutate.found(stored, batch).collect())) == [(1.0, 1.0)] * 2
    with pytest.raises(ValueError):
        mutate.delete_checked(stored, batch)
    kept = mutate.delete_with_payload(frame(spark, [a, a, a, b]), batch, ["x", "y"], ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]


def test_deep_trees_walk_arrays(spark):
    rows = [(random.Random(i).random(), random.Random(i + 1).random()) for i in range(3000)]
    f = SpatialFrame.build(frame(spark, rows), ["x", "y"], 1024)
    assert f.splits.depth() > partition.CASE_DEPTH
    again = f.points.withColumn("case", f.splits._case(1))
    assert again.filter("case <> leaf_id").count() == 0


def test_insert_then_rebalance(spark):
    p = frame(spark, [(i % 40, i // 40) for i in range(800)])
    f = SpatialFrame.build(p.filter("id < 40"), ["x", "y"], 4).insert(p.filter("id >= 40")).rebalance(60)
    assert f.points.count() == 800
    assert f.validate().first()["leaves_hold"]


def test_value_at_rank(spark):
    rows = [(i, float(i % 3), float(i * 7 % 50) if i % 11 else None) for i in range(300)]
    got = value_at_rank(spark.createDataFrame(rows, SCHEMA), "x", "y", lambda n: F.floor(n / 2)).collect()
    want = {}
    for g in range(3):
        values = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        want[float(g)] = (values[len(values) // 2], len(values))
    assert {r["x"]: (r["y"], r["n"]) for r in got} == want
    assert value_at_rank(spark.createDataFrame([], SCHEMA), "x", "y", lambda n: n).count() == 0


def test_exact_split_of_equal_values(spark):
    rows = [(i, 5.0, float(i)) for i in range(8)]
    got = partition.exact_split(spark.createDataFrame(rows, SCHEMA), ["x", "y"], 2).collect()
    assert sorted((r["id"], r["node"]) for r in got) == [(i, 6 if i < 4 else 7) for i in range(8)]


def test_numbered_wide_rows_over_sampled_bounds(spark):
    rows = spark.range(50_000).select("id", (F.col("id") * 7919 % 50_021).cast("double").alias("x"), F.lit("pad").alias("wide"))
    assert numbered(rows, ["x"], "i", 7).filter("i < 0 or i >= 50000").count() == 0
    got = numbered(rows, ["x"], "i", 7)
    wrong = got.alias("a").join(got.alias("b"), F.col("b.i") == F.col("a.i") + 1).filter("b.x <= a.x").count()
    assert wrong == 0 and got.select("i").distinct().count() == 50_000


def test_numbered(spark):
    rows = [(i, float(i * 7 % 50), 0.0) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, SCHEMA), ["x", "id"], "i", 7).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(200))
    assert [(r["x"], r["id"]) for r in got] == sorted((x, i) for i, x, _ in rows)


def test_points_file_round_trip(spark, tmp_path):
    p = frame(spark, [(1.5, 2), (3, 4), (-0.25, 1e6)])
    text_formats.write_points(p, ["x", "y"], str(tmp_path / "p"), ["id"])
    back = text_formats.read_points(spark, str(tmp_path / "p")).orderBy("id").collect()
    assert [(r["x0"], r["x1"]) for r in back] == [(1.5, 2.0), (3.0, 4.0), (-0.25, 1e6)]


def test_headed_points(spark, tmp_path):
    p = frame(spark, [(1, 2), (3, 4)])
    text_formats.write_points(p, ["x", "y"], str(tmp_path / "p"), ["id"], "pbbs_sequencePoint2d")
    assert text_formats.read_headed_points(spark, str(tmp_path / "p"), 2).count() == 2
    with pytest.raises(ValueError):
        text_formats.read_headed_points(spark, str(tmp_path / "p"), 3)


@pytest.mark.parametrize("weighted", [False, True])
def test_graph_files(spark, tmp_path, weighted):
    rows = [(0, 1, 1.0), (0, 2, 4.0), (2, 0, 0.5), (3, 3, 2.0)]
    e = spark.createDataFrame(rows, "u long, v long, w double")
    e = e if weighted else e.drop("w")
    key = lambda df: sorted(map(tuple, df.select(*e.columns).collect()))
    text_formats.write_edges(e, str(tmp_path / "e"))
    assert key(text_formats.read_edges(spark, str(tmp_path / "e"), weighted)) == key(e)
    text_formats.write_csr(e, 4, str(tmp_path / "g"))
    assert key(text_formats.read_csr(spark, str(tmp_path / "g"), weighted)) == key(e)


def test_sequences_and_triangles(spark, tmp_path):
    s = spark.createDataFrame([(0, 5), (1, 7)], "i long, value long")
    text_formats.write_sequence(s, str(tmp_path / "s"), "sequenceInt")
    assert sorted(map(tuple, text_formats.read_sequence(spark, str(tmp_path / "s")).collect())) == [(0, 5), (1, 7)]
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], "id long, x0 double, x1 double")
    t = spark.createDataFrame([(0, 0, 1, 2)], "t long, v0 long, v1 long, v2 long")
    text_formats.write_triangles(p, t, str(tmp_path / "t"))
    points, corners = text_formats.read_triangles(spark, str(tmp_path / "t"))
    assert points.count() == 3
    assert tuple(corners.first()) == (0, 0, 1, 2)


def test_generators_are_seeded(spark):
    a = generators.uniform(spark, 100, 2, seed=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, generators.uniform(spark, 100, 2, seed=3).repartition(7).collect()))
    assert a.filter("x0 < 0 or x0 > 1000000").count() == 0
    washed = generators.washed(spark.createDataFrame([("3 2",), ("7  1   2",)], "value string"))
    assert [r[0] for r in washed.collect()] == ["3 2", "1 2"]


def test_mesh_checks(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 2.0, 1.0), (3, 2.0, -1.0)], "id long, x double, y double")
    bad = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 0, 3)], "t long, v0 long, v1 long, v2 long")
    assert meshes.check_delaunay(bad, p).count() > 0
    assert meshes.check_delaunay(meshes.flip(bad, 0, 1), p).count() == 0
    assert meshes.split(bad, 0, 4, (2, 3)).count() == 4


def test_graph_helpers(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (1, 2)], "u long, v long")
    assert sorted(map(tuple, graphs.symmetric(e).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert [tuple(r) for r in graphs.csr_offsets(e).orderBy("u").collect()] == [(0, 0, 1), (1, 1, 3)]
    perm = graphs.random_permutation(spark.range(5).select(F.col("id").alias("old")))
    assert sorted(r["new"] for r in perm.collect()) == list(range(5))


def test_eps_and_vectors(spark):
    r = spark.range(1).select(G.eps_equal(F.lit(0.0), F.lit(1e-17)).alias("eq"), G.dot([F.lit(1), F.lit(2)], [F.lit(3), F.lit(4)]).alias("dot"), G.cross3([F.lit(1), F.lit(0), F.lit(0)], [F.lit(0), F.lit(1), F.lit(0)])[2].alias("z")).first()
    assert (r["eq"], r["dot"], r["z"]) == (True, 11, 1)


def test_stream_maintains_a_window(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, [(1, 1), (2, 2)]).write.parquet(src)
    q = windows.maintain(spark.readStream.schema(SCHEMA).parquet(src), str(tmp_path / "set"), "epoch", str(tmp_path / "cp"))
    q.awaitTermination()
    assert windows.live(spark, str(tmp_path / "set"), "epoch", 5).count() == 2


def test_stream_counts_match_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(48).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"))
    rows.write.parquet(src)
    out = windows.stream_counts(spark.readStream.schema("ts timestamp").parquet(src), "ts", "2 days", "1 day", "1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = rows.groupBy(F.window("ts", "2 days", "1 day")).count().collect()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == sorted(r["count"] for r in want)


def test_windows_end_with_the_last_batch(spark):
    rows = spark.createDataFrame([(i, i) for i in (0, 3, 28, 29, 31)], "id int, day int")
    got = sorted((r["day"], r["w"]) for r in windows.held(rows, "day", 3, 29).collect())
    assert got == [(d, w) for d in (0, 3, 28, 29) for w in range(d, min(d + 2, 29) + 1)]
    assert windows.last_batch(rows, "day") == 31 and windows.last_batch(rows.limit(0), "day") == -1


def test_tokens_of_several_files_come_in_order(spark, tmp_path):
    # splits are planned by size, the largest first
    for i, n in enumerate((1, 50, 4000)):
        (tmp_path / f"part-{i}.txt").write_text("".join(f"{i}:{k}\n" for k in range(n)))
    got = [r["token"] for r in text_formats.tokens(spark, str(tmp_path)).orderBy("i").collect()]
    assert got == [f"{i}:{k}" for i, n in enumerate((1, 50, 4000)) for k in range(n)]


def test_delaunay_check_does_not_depend_on_the_place(spark):
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "t long, v0 long, v1 long, v2 long")
    for shift, scale in ((0.0, 1.0), (1e4, 1.0), (-1e3, 1e-2)):
        for far, bad in ((0.9, 2), (1.0, 0), (1.1, 0)):
            at = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, far, far)]
            p = spark.createDataFrame([(i, shift + scale * x, shift + scale * y) for i, x, y in at], "id long, x double, y double")
            assert meshes.check_delaunay(t, p).count() == bad


def test_validate_finds_planted_faults(spark):
    p = spark.range(500).select("id", (F.col("id") % 25).cast("double").alias("x"), F.floor(F.col("id") / 25).cast("double").alias("y"))
    f = SpatialFrame.build(p, ["x", "y"], 8)
    assert f.validate().first()["leaves_hold"]
    one = f.points.filter("id = 0").first()["leaf_id"]
    other = f.points.filter(F.col("leaf_id") != one).first()["leaf_id"]
    for wrong in (other, 1, 10**6):
        moved = f.points.withColumn("leaf_id", F.when(F.col("id") == 0, F.lit(wrong)).otherwise(F.col("leaf_id")).cast("long"))
        assert not SpatialFrame(moved, f.dims, f.splits).validate().first()["leaves_hold"]


def test_splits_tell_their_nodes_and_turns(spark):
    p = spark.range(500).select("id", (F.col("id") % 25).cast("double").alias("x"), F.floor(F.col("id") / 25).cast("double").alias("y"))
    s = SpatialFrame.build(p, ["x", "y"], 8, "rotate").splits
    assert s.node_count() == 2 * len(s.cells()) - 1 == 15
    assert s.out_of_turn() == []
    s.nodes[3] = (0, s.nodes[3][1])
    assert s.out_of_turn() == [3]
    assert partition.Splits(["x"]).node_count() == 1


def test_steps_take_the_first_rows_and_no_more(spark):
    p = frame(spark, [(i, i) for i in range(20)])
    f = SpatialFrame.build(p.filter("id < 10"), ["x", "y"], 4)
    got = [(k, now.points.count()) for k, now in increments.by_steps(f, p.filter("id >= 10"), ["id"], 3, 7)]
    assert got == [(1, 13), (2, 16), (3, 17)]
    gone = [sorted(r["id"] for r in now.points.collect()) for _, now in increments.by_steps(f, p, ["id"], 4, 6, ["id"])]
    assert gone == [list(range(4, 10)), list(range(6, 10))]
    assert list(increments.by_steps(f, p, ["id"], 3, 0)) == []


def test_rotated_triangles_have_the_same_neighbours(spark):
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "t long, v0 long, v1 long, v2 long")
    before = {(r["t"], r["k"]): r["other"] for r in meshes.neighbours(t).collect()}
    after = {(r["t"], (r["k"] + 1) % 3): r["other"] for r in meshes.neighbours(meshes.rotated(t)).collect()}
    assert before == after


def test_neighbours_without_a_product_of_queries_and_leaves(spark):
    p = spark.range(2000).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), "x", "y")
    rows = p.collect()
    for leaves, k in ((16, 5), (64, 60)):  # with few points a leaf, leaves with less than k as well
        got = {}
        for r in knn.pruned(SpatialFrame.build(p, ["x", "y"], leaves), q, k, "id").collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["dist2"], r["nid"]))
        for a in q.collect():
            near = sorted(((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2, b["id"]) for b in rows)[:k]
            assert [(d, i) for _, d, i in sorted(got[a["qid"]])] == near
