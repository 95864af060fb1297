"""Triangle meshes: triangles (t, v0, v1, v2) over points (id, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G

#: Slack of the in-circle test, as a share.
TOLERANCE = 1e-10


def directed_edges(triangles: DataFrame) -> DataFrame:
    """(t, k, a, b): edge k runs from corner k to the next."""
    corners = ["v0", "v1", "v2"]
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(corners[k]).alias("a"), F.col(corners[(k + 1) % 3]).alias("b")) for k in range(3)])
    return triangles.select("t", F.explode(each).alias("e")).select("t", "e.k", "e.a", "e.b")


def neighbours(triangles: DataFrame) -> DataFrame:
    """(t, k, other): the triangle across edge k, null on the border."""
    e = directed_edges(triangles)
    across = e.select(F.col("t").alias("other"), F.col("b").alias("a"), F.col("a").alias("b"))
    return e.join(across, ["a", "b"], "left").select("t", "k", "other")


def with_corners(triangles: DataFrame, points: DataFrame) -> DataFrame:
    for k in range(3):
        triangles = triangles.join(points.select(F.col("id").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"v{k}")
    return triangles


def rotated(triangles: DataFrame) -> DataFrame:
    """The same triangles with the next corner first: edge k is edge k + 1 of before."""
    return triangles.withColumns({"v0": F.col("v1"), "v1": F.col("v2"), "v2": F.col("v0")})


def _by_edge(rows: DataFrame, name: str, value) -> DataFrame:
    """(t, k, name): ``value`` of each edge's first corner, second corner and the one that faces it."""
    at = [[F.col(f"x{k}"), F.col(f"y{k}")] for k in range(3)]
    each = [F.struct(F.lit(k).alias("k"), value(at[k], at[(k + 1) % 3], at[(k + 2) % 3]).alias(name)) for k in range(3)]
    return rows.select("t", F.explode(F.array(*each)).alias("__e")).select("t", "__e.k", f"__e.{name}")


def far_angles(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """(t, k, angle): the angle, in degrees, that faces edge k; corners must be apart."""
    return _by_edge(with_corners(triangles, points), "angle", lambda a, b, far: G.angle_degrees(far, a, b))


def outside_edges(triangles: DataFrame, points: DataFrame, asked: DataFrame) -> DataFrame:
    """(t, k) for ``asked`` pairs (t, id): the edges that point id lies beyond, of a triangle whose corners go counter-clockwise."""
    rows = with_corners(triangles.join(asked, "t"), points).join(points.select("id", "x", "y"), "id")
    p = [F.col("x"), F.col("y")]
    return _by_edge(rows, "beyond", lambda a, b, far: G.counter_clockwise(b, a, p)).filter("beyond").select("t", "k")


def check_delaunay(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """Edges (t, k, other) whose far corner lies inside the triangle's circle: none in a Delaunay mesh."""
    beside = neighbours(triangles).filter("other is not null")
    far = triangles.select(F.col("t").alias("other"), F.array("v0", "v1", "v2").alias("far"))
    rows = with_corners(triangles, points).join(beside, "t").join(far, "other")
    apex = F.array_except("far", F.array("v0", "v1", "v2"))[0]
    rows = rows.withColumn("p", apex).join(points.select(F.col("id").alias("p"), "x", "y"), "p")
    a, b, c, p = [[F.col(f"x{k}"), F.col(f"y{k}")] for k in range(3)] + [[F.col("x"), F.col("y")]]
    return rows.filter(G.in_circle_share(a, b, c, p) > TOLERANCE).select("t", "k", "other")


def flip(triangles: DataFrame, t: int, other: int) -> DataFrame:
    """Two triangles over one edge change to the other diagonal; all other rows stay."""
    both = {r["t"]: (r["v0"], r["v1"], r["v2"]) for r in triangles.filter(F.col("t").isin(t, other)).select("t", "v0", "v1", "v2").collect()}
    a, b = both[t], both[other]
    apex = next(v for v in a if v not in b)
    far = next(v for v in b if v not in a)
    i = a.index(apex)
    u, w = a[(i + 1) % 3], a[(i + 2) % 3]
    rows = triangles.sparkSession.createDataFrame([(t, apex, u, far), (other, apex, far, w)], "t long, v0 long, v1 long, v2 long")
    return triangles.filter(~F.col("t").isin(t, other)).unionByName(rows)


def split(triangles: DataFrame, t: int, vertex: int, new: tuple[int, int]) -> DataFrame:
    """A triangle becomes three around a new vertex."""
    r = triangles.filter(F.col("t") == t).select("v0", "v1", "v2").first()
    rows = [(t, r[0], r[1], vertex), (new[0], r[1], r[2], vertex), (new[1], r[2], r[0], vertex)]
    return triangles.filter(F.col("t") != t).unionByName(triangles.sparkSession.createDataFrame(rows, "t long, v0 long, v1 long, v2 long"))
