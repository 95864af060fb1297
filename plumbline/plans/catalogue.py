"""Queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import graphs, increments, knn, meshes, mutate, partition, ranges, reports
from plumbline.operators.ordering import numbered, value_at_rank
from plumbline.operators.partition import SpatialFrame
from plumbline.sources import generators, tables
from plumbline.sources.tables import DUPLICATES_SQL, EVENTS_SQL, LINEITEM_SQL, ORDERS_SQL, PART_SQL
from plumbline.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

XY = ["x", "y"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


# Query sets: the rows whose id is divisible by 100, against all rows.


def _asked(points: DataFrame) -> DataFrame:
    return points.filter(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), *XY)


def _asked_sql(of: str) -> str:
    return f"q AS (SELECT id AS qid, x AS qx, y AS qy FROM {of} WHERE id % 100 = 0)"


def _knn_sql(points: str, k: int, where: str = "true") -> str:
    return f"""SELECT qid, rank, nid, dist2 FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist2, nid) AS INTEGER) AS rank
      FROM (SELECT qid, id AS nid, (x - qx) * (x - qx) + (y - qy) * (y - qy) AS dist2 FROM q, {points} WHERE {where}))
    WHERE rank <= {k}"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_lineitem(spark, sf_dir)


# Sources and scalar functions


@query(f"{_with(PART_SQL)} SELECT id, x, y FROM pt")
def scan_points(spark, d):
    return tables.part(spark, d)


@query(f"{_with(LINEITEM_SQL)} SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS missing, count(DISTINCT id) AS ids FROM li")
def validate_points(spark, d):
    return tables.lineitem(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"), F.countDistinct("id").alias("ids"))


@query(f"{_with(PART_SQL)} SELECT id, '(' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(floor(y) AS BIGINT) AS VARCHAR) || ', )' AS point FROM pt")
def format_points(spark, d):
    return tables.part(spark, d).select("id", G.format_point([F.col("x").cast("long"), F.floor("y")]).alias("point"))


@query(f"{_with(PART_SQL)} SELECT id, CAST(x AS BIGINT) AS a, CAST(floor(y) AS BIGINT) AS b FROM pt")
def parse_point_text(spark, d):
    p = format_points(spark, d).select("id", F.split(F.regexp_replace("point", "[(), ]+", " "), " ").alias("t"))
    return p.select("id", F.col("t")[1].cast("long").alias("a"), F.col("t")[2].cast("long").alias("b"))


_PAIRS = "pr AS (SELECT a.id AS ia, b.id AS ib, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM pt a JOIN pt b ON b.id = a.id + 1)"


def _pairs(spark, d):
    a = tables.part(spark, d).select(F.col("id").alias("ia"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = tables.part(spark, d).select(F.col("id").alias("ib"), F.col("x").alias("bx"), F.col("y").alias("b_y"))
    return a.join(b, F.col("ib") == F.col("ia") + 1)


def _c(*names):
    return [F.col(n) for n in names]


@query(f"{_with(PART_SQL, _PAIRS)} SELECT ia, (ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y) AS dist2, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS len, ax = bx AND ay = b_y AS same, ax < bx OR (ax = bx AND ay < b_y) AS less FROM pr")
def point_pairs(spark, d):
    a, b = _c("ax", "ay"), _c("bx", "b_y")
    return _pairs(spark, d).select("ia", G.dist2(a, b).alias("dist2"), G.length(G.minus(a, b)).alias("len"), G.same_point(a, b).alias("same"), G.point_less(a, b).alias("less"))


@query(f"{_with(PART_SQL, _PAIRS)} SELECT ia, least(ax, bx) AS lx, least(ay, b_y) AS ly, greatest(ax, bx) AS hx, greatest(ay, b_y) AS hy, ax - bx > 2.220446049250313e-16 AS eps_gt, ax - bx < -2.220446049250313e-16 AS eps_lt, abs(ax - bx) < 2.220446049250313e-16 AS eps_eq FROM pr")
def min_max_coords(spark, d):
    a, b = _c("ax", "ay"), _c("bx", "b_y")
    lo, hi = G.least_coords(a, b), G.greatest_coords(a, b)
    return _pairs(spark, d).select("ia", lo[0].alias("lx"), lo[1].alias("ly"), hi[0].alias("hx"), hi[1].alias("hy"), G.eps_greater(a[0], b[0]).alias("eps_gt"), G.eps_less(a[0], b[0]).alias("eps_lt"), G.eps_equal(a[0], b[0]).alias("eps_eq"))


_BOX = "bx AS (SELECT ia, least(ax, bx) AS lx, least(ay, b_y) AS ly, greatest(ax, bx) AS hx, greatest(ay, b_y) AS hy FROM pr)"


@query(f"{_with(PART_SQL, _PAIRS, _BOX)} SELECT ia, pow(greatest(lx - 25, 0, 25 - hx), 2) + pow(greatest(ly - 1400, 0, 1400 - hy), 2) AS near, pow(greatest(abs(25 - lx), abs(hx - 25)), 2) + pow(greatest(abs(1400 - ly), abs(hy - 1400)), 2) AS far FROM bx")
def box_distances(spark, d):
    p, lo, hi = [F.lit(25.0), F.lit(1400.0)], _c("lx", "ly"), _c("hx", "hy")
    return min_max_coords(spark, d).select("ia", G.box_min_dist2(p, lo, hi).alias("near"), G.box_max_dist2(p, lo, hi).alias("far"))


@query(f"""{_with(PART_SQL, _PAIRS, _BOX)} SELECT ia, lx <= hx AND ly <= hy AS legal, 25 BETWEEN lx AND hx AND 1400 BETWEEN ly AND hy AS holds_point,
 lx >= 10 AND hx <= 40 AND ly >= 1000 AND hy <= 1800 AS in_box, hx >= 10 AND lx <= 40 AND hy >= 1000 AND ly <= 1800 AS meets_box,
 pow(greatest(abs(25 - lx), abs(hx - 25)), 2) + pow(greatest(abs(1400 - ly), abs(hy - 1400)), 2) <= 90000 AS in_ball,
 pow(greatest(lx - 25, 0, 25 - hx), 2) + pow(greatest(ly - 1400, 0, 1400 - hy), 2) <= 90000 AS meets_ball,
 CASE WHEN hx - lx >= hy - ly THEN 0 ELSE 1 END AS widest, least(lx, 10) AS union_lx, greatest(hy, 1800) AS union_hy FROM bx""")
def box_predicates(spark, d):
    lo, hi = _c("lx", "ly"), _c("hx", "hy")
    p, r = [F.lit(25.0), F.lit(1400.0)], F.lit(300.0)
    blo, bhi = [F.lit(10.0), F.lit(1000.0)], [F.lit(40.0), F.lit(1800.0)]
    return min_max_coords(spark, d).select(
        "ia", G.legal_box(lo, hi).alias("legal"), G.in_box(p, lo, hi).alias("holds_point"), G.box_in_box(lo, hi, blo, bhi).alias("in_box"), G.boxes_meet(lo, hi, blo, bhi).alias("meets_box"),
        G.box_in_ball(lo, hi, p, r).alias("in_ball"), G.ball_meets_box(p, r, lo, hi).alias("meets_ball"), G.widest_dimension(lo, hi).alias("widest"),
        G.least_coords(lo, blo)[0].alias("union_lx"), G.greatest_coords(hi, bhi)[1].alias("union_hy"),
    )


_TRI = "tr AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy, e.x AS px, e.y AS py FROM pt a JOIN pt b ON b.id = a.id + 1 JOIN pt c ON c.id = a.id + 2 JOIN pt e ON e.id = a.id + 3)"


def _triples(spark, d):
    p = tables.part(spark, d)
    out = p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    for k, (x, y) in enumerate((("bx", "b_y"), ("cx", "cy"), ("px", "py")), 1):
        out = out.join(p.select((F.col("id") - k).alias("id"), F.col("x").alias(x), F.col("y").alias(y)), "id")
    return out, _c("ax", "ay"), _c("bx", "b_y"), _c("cx", "cy"), _c("px", "py")


@query(f"""{_with(PART_SQL, _TRI)} SELECT id, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS area2, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) > 0 AS ccw,
 (ax - px) * ((b_y - py) * ((cx - px) * (cx - px) + (cy - py) * (cy - py)) - ((bx - px) * (bx - px) + (b_y - py) * (b_y - py)) * (cy - py))
 - (ay - py) * ((bx - px) * ((cx - px) * (cx - px) + (cy - py) * (cy - py)) - ((bx - px) * (bx - px) + (b_y - py) * (b_y - py)) * (cx - px))
 + ((ax - px) * (ax - px) + (ay - py) * (ay - py)) * ((bx - px) * (cy - py) - (b_y - py) * (cx - px)) > 0 AS inside,
 CAST((CASE WHEN px > ax THEN 1 ELSE 0 END) + (CASE WHEN py > ay THEN 2 ELSE 0 END) AS INTEGER) AS quadrant FROM tr""")
def triangles(spark, d):
    t, a, b, c, p = _triples(spark, d)
    return t.select("id", G.triangle_area2(a, b, c).alias("area2"), G.counter_clockwise(a, b, c).alias("ccw"), G.in_circle(a, b, c, p).alias("inside"), G.quadrant(p, a).cast("int").alias("quadrant"))


@query(f"""{_with(PART_SQL, _TRI)} SELECT id,
  ax + ((cy - ay) * ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) - (b_y - ay) * ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))) / (2.0::DOUBLE * ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax))) AS ux,
 ay + ((bx - ax) * ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) - (cx - ax) * ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))) / (2.0::DOUBLE * ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax))) AS uy,
 round(acos(least(greatest(((bx - ax) * (cx - ax) + (b_y - ay) * (cy - ay)) / (sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) * sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))), -1.0), 1.0)) * (180.0::DOUBLE / 3.14159::DOUBLE), 4) AS angle
 FROM tr WHERE abs((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) > 1""")
def circumcentres(spark, d):
    t, a, b, c, _ = _triples(spark, d)
    t = t.filter(F.abs(G.triangle_area2(a, b, c)) > 1)
    u = G.circumcentre(a, b, c)
    return t.select("id", u[0].alias("ux"), u[1].alias("uy"), F.round(G.angle_degrees(a, b, c), 4).alias("angle"))


@query(f"""{_with(PART_SQL, _TRI)}, v AS (SELECT *, ax - px AS ux, ay - py AS uy, bx - px AS vx, b_y - py AS vy, cx - px AS wx, cy - py AS wy FROM tr),
 l AS (SELECT *, ux * ux + uy * uy AS uq, vx * vx + vy * vy AS vq, wx * wx + wy * wy AS wq FROM v)
 SELECT id, ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) / nullif(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) * sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)), 0) AS area_share,
 ((uy * vq - uq * vy) * wx + (uq * vx - ux * vq) * wy + (ux * vy - uy * vx) * wq) / nullif(sqrt(ux * ux + uy * uy + uq * uq) * sqrt(vx * vx + vy * vy + vq * vq) * sqrt(wx * wx + wy * wy + wq * wq), 0) AS circle_number FROM l""")
def triangle_shares(spark, d):
    t, a, b, c, p = _triples(spark, d)
    return t.select("id", G.triangle_area_share(a, b, c).alias("area_share"), G.in_circle_number(a, b, c, p).alias("circle_number"))


def _strips(spark, d):
    """Triangles of three successive points that are not in line, with the number of the point after them."""
    t, a, b, c, _ = _triples(spark, d)
    t = t.filter(F.abs(G.triangle_area2(a, b, c)) > 1)
    return t.select(F.col("id").alias("t"), F.col("id").alias("v0"), (F.col("id") + 1).alias("v1"), (F.col("id") + 2).alias("v2"))


def _angle_sql(a, b, c):
    (ax, ay), (bx, by), (cx, cy) = ((f"{s}x", "b_y" if s == "b" else f"{s}y") for s in (a, b, c))
    u, v, w, z = f"({bx} - {ax})", f"({by} - {ay})", f"({cx} - {ax})", f"({cy} - {ay})"
    return f"round(acos(least(greatest(({u} * {w} + {v} * {z}) / (sqrt({u} * {u} + {v} * {v}) * sqrt({w} * {w} + {z} * {z})), -1.0), 1.0)) * (180.0::DOUBLE / 3.14159::DOUBLE), 3)"


_STRIPS = "st AS (SELECT * FROM tr WHERE abs((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) > 1)"


@query(f"{_with(PART_SQL, _TRI, _STRIPS)} SELECT id AS t, 0 AS k, {_angle_sql('c', 'a', 'b')} AS angle FROM st UNION ALL SELECT id, 1, {_angle_sql('a', 'b', 'c')} FROM st UNION ALL SELECT id, 2, {_angle_sql('b', 'c', 'a')} FROM st")
def mesh_angles(spark, d):
    return meshes.far_angles(_strips(spark, d), tables.part(spark, d)).withColumn("angle", F.round("angle", 3))


@query(f"""{_with(PART_SQL, _TRI, _STRIPS)} SELECT id AS t, 0 AS k FROM st WHERE (ax - bx) * (py - b_y) - (ay - b_y) * (px - bx) > 0
 UNION ALL SELECT id, 1 FROM st WHERE (bx - cx) * (py - cy) - (b_y - cy) * (px - cx) > 0 UNION ALL SELECT id, 2 FROM st WHERE (cx - ax) * (py - ay) - (cy - ay) * (px - ax) > 0""")
def mesh_outside(spark, d):
    t = _strips(spark, d)
    return meshes.outside_edges(t, tables.part(spark, d), t.select("t", (F.col("t") + 3).alias("id")))


@query(f"""{_with(PART_SQL, _PAIRS, _BOX)} SELECT ia, 25 > lx AND 25 < hx AND 1400 > ly AND 1400 < hy AS strictly, 25 BETWEEN lx - 2 AND hx + 2 AND 1400 BETWEEN ly - 2 AND hy + 2 AS about,
 lx + 2 >= 10 AND hx - 2 <= 40 AND ly + 2 >= 1000 AND hy - 2 <= 1800 AS in_box, hx - 2 >= 10 AND lx + 2 <= 40 AND hy - 2 >= 1000 AND ly + 2 <= 1800 AS meets_box,
 abs(lx - ax) <= 1e-7 AND abs(ly - ay) <= 1e-7 AND abs(hx - bx) <= 1e-7 AND abs(hy - b_y) <= 1e-7 AS same,
 ax - 300 > 25 OR ax + 300 < 25 OR ay - 300 > 1400 OR ay + 300 < 1400 AS outside, (ia & 7) <= 4 AS low_half FROM bx JOIN pr USING (ia)""")
def slack_predicates(spark, d):
    a, b, p = _c("ax", "ay"), _c("bx", "b_y"), [F.lit(25.0), F.lit(1400.0)]
    lo, hi = G.least_coords(a, b), G.greatest_coords(a, b)
    (wlo, whi), (nlo, nhi) = G.widened(lo, hi, 2.0), G.widened(lo, hi, -2.0)
    blo, bhi = [F.lit(10.0), F.lit(1000.0)], [F.lit(40.0), F.lit(1800.0)]
    return _pairs(spark, d).select(
        "ia", G.strictly_in_box(p, lo, hi).alias("strictly"), G.in_box(p, wlo, whi).alias("about"), G.box_in_box(nlo, nhi, blo, bhi).alias("in_box"), G.boxes_meet(nlo, nhi, blo, bhi).alias("meets_box"),
        G.same_box(lo, hi, a, b, 1e-7).alias("same"), G.outside_cube(p, a, 300.0).alias("outside"), G.in_low_half(F.col("ia"), 3).alias("low_half"),
    )


# Boxes and balls


@query(f"{_with(LINEITEM_SQL)} SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM li")
def bbox_all(spark, d):
    return partition.bounding_box(tables.lineitem(spark, d), XY)


@query("SELECT l_returnflag, min(l_quantity) AS lo_x, max(l_quantity) AS hi_x, min(l_extendedprice) AS lo_y, max(l_extendedprice) AS hi_y FROM lineitem GROUP BY l_returnflag")
def bbox_group(spark, d):
    li = tables.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return partition.bounding_box(li, XY, ["l_returnflag"])


_BOXES = "b AS (SELECT id AS qid, x - 5 AS lx, x + 5 AS hx, y - 2000 AS ly, y + 2000 AS hy FROM pt WHERE id % 100 = 0)"
_BALLS = "b AS (SELECT id AS qid, x AS cx, y AS cy, 50.0 + id % 1000 AS r FROM pt WHERE id % 100 = 0)"


def _boxes(spark, d):
    p = tables.part(spark, d).filter("id % 100 = 0")
    return p.select(F.col("id").alias("qid"), (F.col("x") - 5).alias("qlo_x"), (F.col("x") + 5).alias("qhi_x"), (F.col("y") - 2000).alias("qlo_y"), (F.col("y") + 2000).alias("qhi_y"))


def _balls(spark, d):
    return tables.part(spark, d).filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("x").alias("c_x"), F.col("y").alias("c_y"), (50.0 + F.col("id") % 1000).alias("radius"))


_COUNT_BOXES = f"{_with(LINEITEM_SQL, PART_SQL, _BOXES)} SELECT qid, count(id) AS n FROM b LEFT JOIN li ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy GROUP BY qid"
_COUNT_BALLS = f"{_with(LINEITEM_SQL, PART_SQL, _BALLS)} SELECT qid, count(id) AS n FROM b LEFT JOIN li ON (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r GROUP BY qid"


@query(f"{_with(LINEITEM_SQL)} SELECT count(*) AS n FROM li WHERE x BETWEEN 10 AND 20 AND y BETWEEN 10000 AND 20000")
def range_count_box(spark, d):
    p = tables.lineitem(spark, d)
    return p.filter(G.in_box(_c(*XY), [F.lit(10.0), F.lit(10000.0)], [F.lit(20.0), F.lit(20000.0)])).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_with(LINEITEM_SQL)} SELECT id, x, y FROM li WHERE x BETWEEN 10 AND 12 AND y BETWEEN 10000 AND 20000")
def range_report_box(spark, d):
    return tables.lineitem(spark, d).filter(G.in_box(_c(*XY), [F.lit(10.0), F.lit(10000.0)], [F.lit(12.0), F.lit(20000.0)]))


@query(f"{_with(LINEITEM_SQL)} SELECT count(*) AS n FROM li WHERE (x - 25) * (x - 25) + (y - 30000) * (y - 30000) <= 25000000")
def range_count_ball(spark, d):
    p = tables.lineitem(spark, d)
    return p.filter(G.in_ball(_c(*XY), [F.lit(25.0), F.lit(30000.0)], F.lit(5000.0))).agg(F.count(F.lit(1)).alias("n"))


@query(_COUNT_BOXES)
def range_count_boxes(spark, d):
    return ranges.count_in(tables.lineitem(spark, d), XY, _boxes(spark, d))


@query(_COUNT_BOXES)
def range_count_pruned(spark, d):
    return ranges.count_pruned(SpatialFrame.build(tables.lineitem(spark, d), XY), _boxes(spark, d))


@query(_COUNT_BALLS)
def range_count_balls(spark, d):
    return ranges.count_in(tables.lineitem(spark, d), XY, _balls(spark, d), "ball")


@query(_COUNT_BALLS)
def range_count_balls_pruned(spark, d):
    return ranges.count_pruned(SpatialFrame.build(tables.lineitem(spark, d), XY), _balls(spark, d), "ball")


_REPORT_BOXES = f"{_with(PART_SQL, _BOXES)} SELECT qid, id, x, y FROM b JOIN pt ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy"


@query(_REPORT_BOXES)
def range_report_boxes(spark, d):
    return ranges.report_in(tables.part(spark, d), XY, _boxes(spark, d))


@query(_REPORT_BOXES)
def range_report_pruned(spark, d):
    return ranges.report_pruned(SpatialFrame.build(tables.part(spark, d), XY), _boxes(spark, d)).drop("leaf_id")


@query(f"{_with(PART_SQL, _BALLS)} SELECT qid, id, x, y FROM b JOIN pt ON (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r")
def range_report_balls(spark, d):
    return ranges.report_in(tables.part(spark, d), XY, _balls(spark, d), "ball")


_OPPOSITE = "nm AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM pt), op AS (SELECT a.i AS qid, a.x, a.y, o.x AS ox, o.y AS oy FROM nm a JOIN nm o ON o.i = (a.i + a.n // 2) % a.n)"


@query(f"{_with(PART_SQL, _OPPOSITE)} SELECT qid, least(x, ox) AS qlo_x, greatest(x, ox) AS qhi_x, least(y, oy) AS qlo_y, greatest(y, oy) AS qhi_y FROM op")
def box_from_pairs(spark, d):
    return ranges.pair_boxes(tables.part(spark, d), XY, ["id"])


@query(f"{_with(PART_SQL, _OPPOSITE)} SELECT qid, x AS c_x, y AS c_y, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) AS radius FROM op")
def ball_from_pairs(spark, d):
    return ranges.pair_balls(tables.part(spark, d), XY, ["id"])


@query(f"{_with(ORDERS_SQL, 'nm AS (SELECT *, (row_number() OVER (ORDER BY y, x, id) - 1) // 100 AS qid FROM od)')} SELECT qid, min(x) AS qlo_x, max(x) AS qhi_x, min(y) AS qlo_y, max(y) AS qhi_y FROM nm GROUP BY qid")
def generated_boxes(spark, d):
    return generators.boxes_around(tables.orders(spark, d), XY, 100, ["y", "x", "id"])


# Nearest neighbours


#: A line's id begins with its order's, which is what must be divisible.
_LINES_ASKED = "q AS (SELECT id AS qid, x AS qx, y AS qy FROM li WHERE CAST(split_part(id, '-', 1) AS BIGINT) % 100 = 0)"


@query(f"{_with(LINEITEM_SQL, _LINES_ASKED)} {_knn_sql('li', 10)}")
def knn_lineitem(spark, d):
    p = tables.lineitem(spark, d)
    return knn.knn(p, tables.lineitem(spark, d, "l_orderkey % 100 = 0").select(F.col("id").alias("qid"), *XY), 10, XY, "id")


@query(f"{_with(PART_SQL, 'q AS (SELECT 0 AS qid, 25.0::DOUBLE AS qx, 1400.0::DOUBLE AS qy)')} {_knn_sql('pt', 5)}")
def knn_single(spark, d):
    q = spark.range(1).select(F.col("id").cast("int").alias("qid"), F.lit(25.0).alias("x"), F.lit(1400.0).alias("y"))
    return knn.knn(tables.part(spark, d), q, 5, XY, "id")


def _brute(points: DataFrame, queries: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    q = queries.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"))
    p = points.select(F.col("id").alias("nid"), *XY)
    return knn.brute(p, q, k, G.dist2(_c(*XY), _c("qx", "qy")), include_self, [("x", "qx"), ("y", "qy")])


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_knn_sql('pt', 10)}")
def knn_brute(spark, d):
    p = tables.part(spark, d)
    return _brute(p, _asked(p), 10)


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_knn_sql('pt', 1)}")
def knn_1(spark, d):
    p = tables.part(spark, d)
    return knn.knn(p, _asked(p), 1, XY, "id")


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_knn_sql('pt', 100)}")
def knn_100(spark, d):
    p = tables.part(spark, d)
    return knn.knn(p, _asked(p), 100, XY, "id")


@query(f"{_with(PART_SQL, 'q AS (SELECT id AS qid, x AS qx, y AS qy FROM pt)')} {_knn_sql('pt', 5)}")
def knn_self(spark, d):
    p = tables.part(spark, d)
    return knn.knn(p, p.select(F.col("id").alias("qid"), *XY), 5, XY, "id")


@query(f"{_with(PART_SQL, 'q AS (SELECT id AS qid, x AS qx, y AS qy FROM pt)')} {_knn_sql('pt', 5, 'id <> qid')}")
def knn_exclude_self(spark, d):
    p = tables.part(spark, d)
    return knn.knn(p, p.select(F.col("id").alias("qid"), *XY), 5, XY, "id", include_self=False)


@query("""WITH d AS (SELECT s_suppkey AS qid, c_custkey AS nid, (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) AS dist2 FROM supplier, customer)
SELECT qid, CAST(rank AS INTEGER) AS rank, nid, dist2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist2, nid) AS rank FROM d) WHERE rank <= 5""")
def knn_bichromatic(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    s = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_acctbal").alias("x"))
    return knn.knn(c, s, 5, ["x"], "id")


@query(f"{_with(PART_SQL, 'q AS (SELECT id AS qid, x + 500 AS qx, y + 20000 AS qy FROM pt WHERE id % 100 = 0)')} {_knn_sql('pt', 10)}")
def knn_remote(spark, d):
    p = tables.part(spark, d)
    return knn.knn(p, _asked(p).select("qid", (F.col("x") + 500).alias("x"), (F.col("y") + 20000).alias("y")), 10, XY, "id")


@query(f"{_with(PART_SQL, ORDERS_SQL, _asked_sql('od'))} {_knn_sql('pt', 10)}")
def knn_other_distribution(spark, d):
    return knn.knn(tables.part(spark, d), _asked(tables.orders(spark, d)), 10, XY, "id")


@query("""WITH q AS (SELECT vec_id AS qid, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS qe FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT vec_id AS nid, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS pe FROM embeddings),
d AS (SELECT qid, nid, list_sum(list_transform(list_zip(pe, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist2 FROM q, p)
SELECT qid, CAST(rank AS INTEGER) AS rank, nid, dist2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist2, nid) AS rank FROM d) WHERE rank <= 10""")
def knn_high_dimensional(spark, d):
    e = tables.table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"))
    return knn.brute(e.select(F.col("vec_id").alias("nid"), "embedding"), q, 10, G.array_dist2(F.col("embedding"), F.col("qe")))


_KTH = "SELECT qid, max(dist2) AS kth_dist2, count(*) AS found FROM ({}) GROUP BY qid"


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_KTH.format(_knn_sql('pt', 10))}")
def kth_distance(spark, d):
    p = tables.part(spark, d)
    return knn.kth_distance(knn.knn(p, _asked(p), 10, XY, "id"))


_GRAPH = "SELECT qid AS src, nid AS dst, dist2 AS weight FROM ({})".format(_knn_sql("pt", 4))
_ALL_PT = "q AS (SELECT id AS qid, x AS qx, y AS qy FROM pt)"


@query(f"{_with(PART_SQL, _ALL_PT)} {_GRAPH}")
def knn_graph(spark, d):
    return knn.graph(tables.part(spark, d), 4, XY, "id")


@query(f"{_with(PART_SQL, _ALL_PT, f'g AS ({_GRAPH})')} SELECT dst, count(*) AS n FROM g GROUP BY dst")
def knn_reverse_degree(spark, d):
    return knn_graph(spark, d).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_with(PART_SQL, _ALL_PT, f'g AS ({_GRAPH})')} SELECT src AS u, CAST(sum(count(*)) OVER (ORDER BY src) - count(*) AS BIGINT) AS \"offset\", count(*) AS degree FROM g GROUP BY src")
def knn_graph_offsets(spark, d):
    return graphs.csr_offsets(knn_graph(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v")))


# Mutation: a batch is the first orders by id


_ALL_DU = DUPLICATES_SQL
_BATCH = "bt AS (SELECT x, y FROM (SELECT l_quantity AS x, l_discount AS y, l_orderkey FROM lineitem WHERE l_orderkey % 10 = 0) UNION ALL SELECT 999.0, 9.0)"


def _batch(spark, d):
    li = tables.table(spark, d, "lineitem").filter(F.col("l_orderkey") % 10 == 0).select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return li.unionByName(spark.range(1).select(F.lit(999.0).alias("x"), F.lit(9.0).alias("y")))


_TALLY = "SELECT x, y, count(*) AS n FROM ({}) GROUP BY x, y"


def _tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_with(_ALL_DU, _BATCH)} {_TALLY.format('SELECT * FROM du UNION ALL SELECT * FROM bt')}")
def batch_insert(spark, d):
    return _tally(mutate.insert(tables.duplicates(spark, d), _batch(spark, d)))


@query(f"{_with(_ALL_DU, _BATCH)} {_TALLY.format('SELECT * FROM du EXCEPT ALL SELECT * FROM bt')}")
def batch_delete_partial(spark, d):
    return _tally(mutate.delete(tables.duplicates(spark, d), _batch(spark, d)))


@query(f"{_with(_ALL_DU, _BATCH)} {_TALLY.format('SELECT * FROM du EXCEPT ALL SELECT * FROM bt WHERE x < 999')}")
def batch_delete_full(spark, d):
    return _tally(mutate.delete_checked(tables.duplicates(spark, d), _batch(spark, d).filter("x < 999")))


@query(f"{_with(_ALL_DU, _BATCH)} {_TALLY.format('SELECT * FROM du INTERSECT ALL SELECT * FROM bt')}")
def delete_found_set(spark, d):
    return _tally(mutate.found(tables.duplicates(spark, d), _batch(spark, d)))


@query(f"{_with(_ALL_DU)} {_TALLY.format('SELECT * FROM du')}")
def insert_then_delete_identity(spark, d):
    p, b = tables.duplicates(spark, d), _batch(spark, d)
    return _tally(mutate.delete(mutate.insert(p, b), b))


@query(f"{_with(PART_SQL)} SELECT id, x, y FROM pt UNION ALL SELECT -1, 1.0, 2.0")
def point_insert(spark, d):
    return mutate.insert(tables.part(spark, d), spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))


@query(f"{_with(PART_SQL)} SELECT id, x, y FROM pt WHERE id <> (SELECT min(id) FROM pt)")
def point_delete(spark, d):
    p = tables.part(spark, d)
    return mutate.delete(p, p.orderBy("id").limit(1))


@query(f"""{_with(PART_SQL)} SELECT id, x FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY id) AS r FROM pt) p
LEFT JOIN (SELECT x AS ax, count(*) AS asked FROM pt WHERE id % 3 = 0 GROUP BY x) a ON p.x = a.ax WHERE asked IS NULL OR r > asked""")
def delete_with_payload(spark, d):
    p = tables.part(spark, d).select("id", "x")
    return mutate.delete_with_payload(p, p.filter("id % 3 = 0").select("x"), ["x"], ["id"])


@query(f"{_with(PART_SQL)} SELECT x, y, count(*) AS n FROM (SELECT * FROM pt WHERE id % 2 = 0 UNION ALL SELECT * FROM pt WHERE id % 2 = 1 EXCEPT ALL SELECT * FROM pt WHERE id % 5 = 0) GROUP BY x, y")
def frame_insert_delete(spark, d):
    p = tables.part(spark, d)
    f = SpatialFrame.build(p.filter("id % 2 = 0"), XY).insert(p.filter("id % 2 = 1")).delete(p.filter("id % 5 = 0"), ["id", "x", "y"])
    return _tally(f.points)


@query("SELECT x AS x, y AS y FROM (SELECT DISTINCT l_quantity AS x, l_discount AS y FROM lineitem)")
def distinct_points(spark, d):
    return tables.duplicates(spark, d).distinct()


# Incremental work


@query(f"{_with(ORDERS_SQL)} SELECT s AS step, (SELECT count(*) FROM od WHERE id % 10 < s) AS n, (SELECT max(x) FROM od WHERE id % 10 < s) AS hi_x FROM range(1, 11) t(s)")
def incremental_build(spark, d):
    p = tables.orders(spark, d)
    f, out = SpatialFrame.build(p.filter("id % 10 = 0"), XY), None
    for step in range(1, 11):
        if step > 1:
            f = f.insert(p.filter(F.col("id") % 10 == step - 1)).settled()
        row = f.stats().agg(F.sum("n").alias("n"), F.max("hi_x").alias("hi_x")).select(F.lit(step).cast("long").alias("step"), "n", "hi_x")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_with(ORDERS_SQL)} SELECT s AS step, (SELECT count(*) FROM od WHERE id % 10 >= s) AS n FROM range(1, 10) t(s)")
def incremental_delete(spark, d):
    p = tables.orders(spark, d)
    f, out = SpatialFrame.build(p, XY), None
    for step in range(1, 10):
        f = f.delete(p.filter(F.col("id") % 10 == step - 1), ["id", "x", "y"]).settled()
        row = f.stats().agg(F.sum("n").alias("n")).select(F.lit(step).cast("long").alias("step"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_STEPS = """wi AS (SELECT id, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS m FROM pt WHERE id % 2 = 1),
st AS (SELECT greatest(1, max(m) * 3 // 100) AS rows_each, max(m) // 10 AS most FROM wi), sp AS (SELECT s, least(s * rows_each, most) AS upto FROM st, range(1, 100) t(s) WHERE (s - 1) * rows_each < most)"""


def _stepped(p: DataFrame, f: SpatialFrame, key: list[str] | None) -> DataFrame:
    """Counts and sums of ids after each step of 3 % of the odd ids, up to 10 % of them."""
    batch = p.filter("id % 2 = 1")
    m, out = batch.count(), None
    for step, now in increments.by_steps(f, batch, ["id"], max(1, m * 3 // 100), m // 10, key):
        row = now.points.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(F.lit(step).cast("long").alias("step"), "n", "ids")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else p.sparkSession.createDataFrame([], "step long, n long, ids long")


@query(f"{_with(PART_SQL, _STEPS)} SELECT s AS step, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM sp, (SELECT id, 0 AS r FROM pt WHERE id % 2 = 0 UNION ALL SELECT id, r FROM wi) a WHERE r <= upto GROUP BY s")
def insert_by_step(spark, d):
    p = tables.part(spark, d)
    return _stepped(p, SpatialFrame.build(p.filter("id % 2 = 0"), XY), None)


@query(f"{_with(PART_SQL, _STEPS)} SELECT s AS step, count(*) AS n, CAST(sum(p.id) AS BIGINT) AS ids FROM sp, pt p LEFT JOIN wi ON wi.id = p.id WHERE r IS NULL OR r > upto GROUP BY s")
def delete_by_step(spark, d):
    p = tables.part(spark, d)
    return _stepped(p, SpatialFrame.build(p, XY), ["id", "x", "y"])


@query(f"{_with(PART_SQL, _asked_sql('pt'))} " + " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS step, * FROM ({_knn_sql('pt', 1, f'id % 10 < {s}')})" for s in (5, 10)))
def incremental_build_and_query(spark, d):
    p, out = tables.part(spark, d), None
    for step, f in increments.grown(p, XY, F.col("id") % 10, 10, 5):
        rows = knn.pruned(f, _asked(p), 1, "id").select(F.lit(step).cast("long").alias("step"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_knn_sql('pt', 10)}")
def knn_after_insert(spark, d):
    p = tables.part(spark, d)
    f = SpatialFrame.build(p.filter("id % 2 = 0"), XY)
    return knn.pruned(f.insert(p.filter("id % 2 = 1")), _asked(p), 10, "id")


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_knn_sql('pt', 10, 'id % 4 <> 1')}")
def knn_after_delete(spark, d):
    p = tables.part(spark, d)
    f = SpatialFrame.build(p, XY).delete(p.filter("id % 4 = 1"), ["id", "x", "y"]).settled()
    return knn.pruned(f, _asked(p), 10, "id")


@query(f"{_with(PART_SQL, _asked_sql('pt'))} {_knn_sql('pt', 10)}")
def knn_after_rebalance(spark, d):
    p = tables.part(spark, d)
    return knn.pruned(SpatialFrame.build(p, XY, 4).rebalance(max(16, p.count() // 8)), _asked(p), 10, "id")


_WINDOWED = "w AS (SELECT *, unnest(range(day, least(day + 4, (SELECT max(day) FROM ev)) + 1)) AS w FROM ev)"


@query(f"{_with(EVENTS_SQL, _WINDOWED)} SELECT CAST(w AS INTEGER) AS w, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM w GROUP BY w")
def sliding_window_stats(spark, d):
    e = tables.events(spark, d)
    return windows.merged(e, "day", 5, windows.last_batch(e, "day"), XY)


@query(f"{_with(EVENTS_SQL, _WINDOWED)} SELECT CAST(w AS INTEGER) AS w, count(DISTINCT x) AS users FROM w GROUP BY w")
def sliding_window_users(spark, d):
    e = tables.events(spark, d)
    return windows.window_stats(e, "day", 5, windows.last_batch(e, "day"), [F.countDistinct("x").alias("users")])


@query(f"""{_with(EVENTS_SQL, _WINDOWED)}, d AS (SELECT w, id AS nid, (x - 500) * (x - 500) + (y - 50) * (y - 50) AS dist2 FROM w)
SELECT CAST(w AS INTEGER) AS w, nid, dist2 FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY dist2, nid) AS r FROM d) WHERE r <= 10""")
def sliding_window_knn(spark, d):
    from pyspark.sql import Window

    e = tables.events(spark, d)
    rows = windows.held(e, "day", 5, windows.last_batch(e, "day"))
    rows = rows.select("w", F.col("id").alias("nid"), G.dist2(_c(*XY), [F.lit(500.0), F.lit(50.0)]).alias("dist2"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("dist2", "nid"))).filter("r <= 10").drop("r")


@query("SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS n FROM (SELECT DISTINCT ts, user_id, value FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-25') GROUP BY ALL")
def period_partition(spark, d):
    e = tables.table(spark, d, "events").select("ts", F.col("user_id").alias("lon"), F.col("value").alias("lat"))
    return generators.by_period(e, "2024-01-05 00:00:00", "2024-01-25 00:00:00").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


# Partitioning


_SPLIT = """s1 AS (SELECT *, row_number() OVER (ORDER BY x, id) - 1 AS r, count(*) OVER () AS n FROM pt),
v1 AS (SELECT max(x) FILTER (WHERE r = n // 2) AS m, min(x) AS l FROM s1), w1 AS (SELECT CASE WHEN m > l THEN m ELSE coalesce((SELECT min(x) FROM pt, v1 WHERE x > m), m) END AS v FROM v1),
n1 AS (SELECT pt.*, CASE WHEN x < v THEN 2 ELSE 3 END AS node FROM pt, w1),
s2 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY y, id) - 1 AS r, count(*) OVER (PARTITION BY node) AS n FROM n1),
v2 AS (SELECT node, max(y) FILTER (WHERE r = n // 2) AS m, min(y) AS l FROM s2 GROUP BY node),
w2 AS (SELECT node, CASE WHEN m > l THEN m ELSE coalesce((SELECT min(y) FROM n1 WHERE n1.node = v2.node AND y > m), m) END AS v FROM v2),
n2 AS (SELECT n1.id, n1.x, n1.y, 2 * n1.node + CASE WHEN y < v THEN 0 ELSE 1 END AS node FROM n1 JOIN w2 USING (node))"""


@query(f"{_with(PART_SQL, _SPLIT)} SELECT id, CAST(node AS BIGINT) AS node FROM n2")
def kd_split_exact(spark, d):
    return partition.exact_split(tables.part(spark, d), XY, 2).select("id", "node")


@query(f"{_with(PART_SQL, _SPLIT)} SELECT CAST(node AS BIGINT) AS node, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, 2 AS depth FROM n2 GROUP BY node")
def leaf_stats(spark, d):
    return partition.zone_map(partition.exact_split(tables.part(spark, d), XY, 2), XY, "node")


@query(f"{_with(PART_SQL, _SPLIT)} SELECT CAST(node // 2 AS BIGINT) AS parent, count(*) AS total, floor(abs(100.0 * count(*) FILTER (WHERE node % 2 = 0) / count(*) - 50)) > 1 AS unbalanced FROM n2 GROUP BY node // 2")
def imbalance_flags(spark, d):
    s = leaf_stats(spark, d).groupBy(F.floor(F.col("node") / 2).alias("parent")).agg(F.sum(F.when(F.col("node") % 2 == 0, F.col("n")).otherwise(0)).alias("left"), F.sum("n").alias("total"))
    return s.select("parent", "total", G.out_of_balance(F.col("left"), F.col("total"), 1).alias("unbalanced"))


@query(f"{_with(PART_SQL, _SPLIT)} SELECT n AS size, count(*) AS leaves FROM (SELECT node, count(*) AS n FROM n2 GROUP BY node) GROUP BY n")
def leaf_size_histogram(spark, d):
    return leaf_stats(spark, d).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("leaves"))


@query(f"{_with(PART_SQL, _SPLIT)} SELECT 2 * count(DISTINCT node) - 1 AS nodes FROM n2")
def tree_nodes(spark, d):
    return leaf_stats(spark, d).agg((2 * F.count(F.lit(1)) - 1).alias("nodes"))


@query(f"{_with(LINEITEM_SQL)} SELECT count(*) AS n_points,CAST(count(*) AS BIGINT) AS n_in_leaves, true AS leaves_hold, true AS sizes_hold FROM li")
def validate_tree(spark, d):
    return SpatialFrame.build(tables.lineitem(spark, d), XY, 256).validate().select("n_points", "n_in_leaves", "leaves_hold", "sizes_hold")


@query(f"{_with(DUPLICATES_SQL)} SELECT count(*) AS n FROM du")
def kd_split_duplicates(spark, d):
    return SpatialFrame.build(tables.duplicates(spark, d), XY, 64, "rotate").stats().agg(F.sum("n").alias("n"))


@query()
def leaf_depth_stats(spark, d):
    return SpatialFrame.build(tables.lineitem(spark, d), XY, 256).validate()


_Z = """bb AS (SELECT min(x) AS lx, min(y) AS ly, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM pt),
ce AS (SELECT id, least(CAST(floor((x - lx) * 255.0 / side) AS BIGINT), 255) AS a, least(CAST(floor((y - ly) * 255.0 / side) AS BIGINT), 255) AS b FROM pt, bb),
zz AS (SELECT id, """ + " + ".join(f"((a >> {i}) & 1) * {1 << (2 * i)} + ((b >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(8)) + " AS z FROM ce)"


@query(f"{_with(PART_SQL, _Z)} SELECT id, CAST(z AS BIGINT) AS z FROM zz")
def zorder_key(spark, d):
    return partition.zorder(tables.part(spark, d), XY, 8).select("id", "z")


@query(f"{_with(PART_SQL, _Z)} SELECT id, row_number() OVER (ORDER BY z, id) - 1 AS place FROM zz")
def zorder_sort_rank(spark, d):
    return numbered(partition.zorder(tables.part(spark, d), XY, 8), ["z", "id"], "place").select("id", F.col("place").cast("long"))


@query(f"{_with(PART_SQL, _Z)} SELECT CAST(z >> 10 AS BIGINT) AS prefix, count(*) AS n FROM zz GROUP BY z >> 10")
def zorder_prefix_counts(spark, d):
    return zorder_key(spark, d).groupBy(F.shiftright("z", 10).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_with(ORDERS_SQL)} SELECT id, row_number() OVER (ORDER BY x, y, id) - 1 AS place FROM od")
def order_rank(spark, d):
    return numbered(tables.orders(spark, d), ["x", "y", "id"], "place").select("id", F.col("place").cast("long"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY l_returnflag")
def exact_median(spark, d):
    rows = tables.table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("median"))
    return value_at_rank(rows, "l_returnflag", "median", lambda n: F.ceil(n / 2) - 1).drop("n")


# Graphs: customers to nations of suppliers, by orders


_EDGES = "e AS (SELECT l_suppkey AS u, l_partkey % 200 AS v FROM lineitem)"


def _edges(spark, d):
    return tables.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 200).alias("v"))


@query(f"{_with(_EDGES)} SELECT DISTINCT u, v FROM e")
def edges_dedup(spark, d):
    return graphs.dedup(_edges(spark, d))


_SYM = "SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v"


@query(f"{_with(_EDGES)} {_SYM}")
def edges_symmetric(spark, d):
    return graphs.symmetric(_edges(spark, d))


@query(f"{_with(_EDGES)} SELECT u, count(*) AS degree FROM e GROUP BY u")
def degree(spark, d):
    return graphs.degrees(_edges(spark, d))


@query(f"{_with(_EDGES)} SELECT u, CAST(sum(count(*)) OVER (ORDER BY u) - count(*) AS BIGINT) AS \"offset\", count(*) AS degree FROM e GROUP BY u")
def csr_offsets(spark, d):
    return graphs.csr_offsets(_edges(spark, d))


@query(f"{_with(_EDGES)} SELECT u, v FROM e")
def csr_round_trip(spark, d):
    return graphs.edges_of(graphs.adjacency(_edges(spark, d)))


@query(f"{_with(_EDGES)} SELECT 100000 - u AS u, 100000 - v AS v FROM e")
def relabel_vertices(spark, d):
    e = _edges(spark, d)
    ids = e.select(F.col("u").alias("old")).unionByName(e.select(F.col("v").alias("old"))).distinct()
    return graphs.relabelled(e, ids.select("old", (100000 - F.col("old")).alias("new")))


@query(f"{_with(_EDGES)} SELECT DISTINCT v AS u FROM e WHERE u < 5 AND v % 2 = 0")
def edge_map_step(spark, d):
    e = _edges(spark, d)
    return graphs.edge_map(e.filter("u < 5").select("u"), e, F.col("v") % 2 == 0)


@query(f"{_with(_EDGES, f's AS ({_SYM})', 'bfs AS (SELECT 1 AS u, 0 AS level)')} SELECT u, min(level) AS level FROM (SELECT 1::BIGINT AS u, 0 AS level UNION ALL SELECT v, 1 FROM s WHERE u = 1 UNION ALL SELECT b.v, 2 FROM s a JOIN s b ON b.u = a.v WHERE a.u = 1) GROUP BY u")
def breadth_first(spark, d):
    return graphs.breadth_first(edges_symmetric(spark, d), spark.range(1, 2).select(F.col("id").alias("u")), 2)


@query(f"{_with(_EDGES)} SELECT count(*) AS m, CAST(count(*) FILTER (WHERE u >= 50 OR v >= 50 OR u < 0 OR v < 0) AS BIGINT) AS outside, count(*) AS degree_sum, count(*) FILTER (WHERE u >= 50 OR v >= 50 OR u < 0 OR v < 0) = 0 AS holds FROM e")
def graph_consistency(spark, d):
    return graphs.consistency(_edges(spark, d), 50)


@query(f"{_with(_EDGES)} SELECT greatest(max(u), max(v)) + 1 AS n FROM e")
def vertex_count(spark, d):
    return graphs.vertex_count(_edges(spark, d))


@query(f"{_with(_EDGES, 'w AS (SELECT v AS cell, min(u) AS winner FROM e GROUP BY v)')} SELECT u AS item FROM e JOIN w ON v = cell GROUP BY u HAVING bool_and(u = winner)")
def first_reservations(spark, d):
    return graphs.first_reservations(_edges(spark, d).select(F.col("u").alias("item"), F.col("v").alias("cell")))


_GRID = """g AS (SELECT i, i // 20 AS r, i % 20 AS c FROM range(400) t(i)), t AS (
SELECT 2 * i AS t, r * 21 + c AS v0, r * 21 + c + 1 AS v1, (r + 1) * 21 + c AS v2 FROM g UNION ALL
SELECT 2 * i + 1, r * 21 + c + 1, (r + 1) * 21 + c + 1, (r + 1) * 21 + c FROM g),
e AS (SELECT t, 0 AS k, v0 AS a, v1 AS b FROM t UNION ALL SELECT t, 1, v1, v2 FROM t UNION ALL SELECT t, 2, v2, v0 FROM t)"""


def _grid(spark):
    g = spark.range(400).select("id", F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"))
    at = lambda dr, dc: (F.col("r") + dr) * 21 + F.col("c") + dc
    low = g.select((2 * F.col("id")).alias("t"), at(0, 0).alias("v0"), at(0, 1).alias("v1"), at(1, 0).alias("v2"))
    return low.unionByName(g.select((2 * F.col("id") + 1).alias("t"), at(0, 1).alias("v0"), at(1, 1).alias("v1"), at(1, 0).alias("v2")))


@query(f"{_with(_GRID)} SELECT e.t, e.k, o.t AS other FROM e LEFT JOIN e o ON o.a = e.b AND o.b = e.a")
def mesh_neighbours(spark, d):
    return meshes.neighbours(_grid(spark))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def mesh_delaunay(spark, d):
    p = spark.range(441).select("id", (F.col("id") % 21).cast("double").alias("x"), F.floor(F.col("id") / 21).cast("double").alias("y"))
    return meshes.check_delaunay(_grid(spark), p).agg(F.count(F.lit(1)).alias("violations"))


# Reports


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geo_mean FROM lineitem GROUP BY l_returnflag")
def geo_mean_report(spark, d):
    return tables.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(reports.geometric_mean(F.col("l_extendedprice")), 4).alias("geo_mean"))


_MEANS = "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount FROM lineitem GROUP BY l_returnflag, l_linestatus"


@query(_MEANS)
def avg_by_group(spark, d):
    return reports.mean_by(tables.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"], 4)


@query(f"WITH m AS ({_MEANS}) SELECT l_returnflag, max(l_quantity) FILTER (WHERE l_linestatus = 'F') AS F, max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS O FROM m GROUP BY l_returnflag")
def pivot_report(spark, d):
    return reports.wide(avg_by_group(spark, d), ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"])


@query(f"WITH m AS ({_MEANS}) SELECT l_returnflag, l_linestatus, 'l_quantity' AS name, l_quantity AS value FROM m UNION ALL SELECT l_returnflag, l_linestatus, 'l_discount', l_discount FROM m")
def unpivot_report(spark, d):
    return reports.long(avg_by_group(spark, d), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query(f"{_with(PART_SQL)} SELECT id, CAST(CASE WHEN id < 100 THEN 1 WHEN id < 200 THEN 2 ELSE 3 END AS INTEGER) AS bracket FROM pt")
def bracket_report(spark, d):
    return tables.part(spark, d).select("id", reports.bracket(F.col("id"), 100, 200).alias("bracket"))


_LINES = "ln AS (SELECT id, id || ' ' || CAST(CAST(x AS BIGINT) AS VARCHAR) AS value, row_number() OVER (ORDER BY id) AS r FROM pt)"


def _lines(spark, d):
    return tables.part(spark, d).select("id", F.concat_ws(" ", "id", F.col("x").cast("long")).alias("value"))


@query(f"{_with(PART_SQL, _LINES)} SELECT id, coalesce(CAST({list(reports.RATIOS)}[r // 2] AS VARCHAR), '') || ' ' || value AS value FROM ln WHERE r % 2 = 0")
def even_lines_report(spark, d):
    return reports.even_lines(_lines(spark, d), ["id"])


@query(f"{_with(PART_SQL, _LINES)} SELECT id, replace(value, ' ', ',') AS value FROM ln")
def comma_report(spark, d):
    return _lines(spark, d).select("id", reports.with_commas(F.col("value")).alias("value"))


# Generators


@query(f"{_with(PART_SQL)} SELECT id, CAST(floor(CAST('0x' || substr(md5('1|' || CAST(id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * 97) AS BIGINT) + 3 AS i FROM pt")
def random_indexes(spark, d):
    return tables.part(spark, d).select("id", generators.random_index(3, 100, "id").alias("i"))


# Without SQL


@query()
def generate_uniform(spark, d):
    return generators.uniform(spark, 10_000, 3)


@query()
def generate_clustered(spark, d):
    return generators.clustered(spark, 10_000, 3)


@query()
def generate_walks(spark, d):
    return generators.random_walks(spark, 20, 500, 2)


@query()
def random_shuffle(spark, d):
    return graphs.shuffled(_edges(spark, d))


@query()
def weighted_edges(spark, d):
    return graphs.add_weights(_edges(spark, d))


@query()
def shifted_queries(spark, d):
    return generators.shifted_queries(tables.part(spark, d), XY, 10.0, 100)
