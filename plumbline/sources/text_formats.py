"""Text formats for points, sequences, graphs and meshes. Files are read and written by Spark, so any of its stores will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import numbered


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(i, token) of text files, in the order of their paths, then of lines; separators are white space and NUL."""
    each = _lines(spark, path).select(*_PLACE, F.posexplode(F.split("value", r"[\s\x00]+")).alias("__k", "token")).filter("token <> ''")
    return numbered(each, [*_PLACE, "__k"]).select("i", "token")


#: Splits are planned by size, so a line's place is its file, then its split, then its number within that.
_PLACE = ["__f", "__b", "__l"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__l"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``N DIM`` and then coordinates in any line layout -> (id, x0, x1, ...). Ids are places in the file."""
    every = tokens(spark, path)
    n, d = (int(r["token"]) for r in every.filter("i < 2").orderBy("i").collect())
    return _records(every.filter("i >= 2"), 2, d).filter(F.col("id") < n)


def read_headed_points(spark: SparkSession, path: str, d: int) -> DataFrame:
    """A ``pbbs_sequencePoint{d}d`` file."""
    _expect(spark, path, f"pbbs_sequencePoint{d}d")
    return _records(tokens(spark, path).filter("i >= 1"), 1, d)


def _expect(spark: SparkSession, path: str, header: str) -> None:
    first = _lines(spark, path).filter(F.trim("value") != "").orderBy(*_PLACE).first()
    if first is None or first[0].split()[:1] != [header]:
        raise ValueError(f"{path}: not headed {header}")


def _records(t: DataFrame, skip: int, d: int) -> DataFrame:
    at = F.col("i") - skip
    flat = t.select(F.floor(at / d).alias("id"), (at % d).alias("k"), F.col("token").cast("double").alias("x"))
    return flat.groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(f"x{k}") for k in range(d)])


def read_sequence(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """A ``sequence{Kind}`` file -> (i, value), or (i, first, second) for pairs."""
    headers = {"int": "sequenceInt", "double": "sequenceDouble", "string": "sequenceChar", "int_pair": "sequenceIntPair", "string_int_pair": "sequenceStringIntPair", "double_pair": "sequenceDoublePair"}
    _expect(spark, path, headers[kind])
    t = tokens(spark, path).filter("i >= 1").withColumn("i", F.col("i") - 1)
    types = {"int": ["long"], "double": ["double"], "string": ["string"], "int_pair": ["long"] * 2, "string_int_pair": ["string", "long"], "double_pair": ["double"] * 2}[kind]
    if len(types) == 1:
        return t.select("i", F.col("token").cast(types[0]).alias("value"))
    pairs = t.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(*[F.max(F.when(F.col("i") % 2 == k, F.col("token"))).cast(types[k]).alias(name) for k, name in enumerate(("first", "second"))])
    return pairs


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """An ``EdgeArray`` or ``WeightedEdgeArray`` file -> (u, v[, w])."""
    _expect(spark, path, "WeightedEdgeArray" if weighted else "EdgeArray")
    d = 3 if weighted else 2
    r = _records(tokens(spark, path).filter("i >= 1"), 1, d)
    return r.select(F.col("x0").cast("long").alias("u"), F.col("x1").cast("long").alias("v"), *([F.col("x2").alias("w")] if weighted else []))


def read_csr(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """An ``AdjacencyGraph`` or ``WeightedAdjacencyGraph`` file -> (u, v[, w]): each edge finds the last offset at or before it."""
    _expect(spark, path, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph")
    t = tokens(spark, path).filter("i >= 1").select((F.col("i") - 1).alias("i"), "token")
    n, m = (int(r[0]) for r in t.filter("i < 2").orderBy("i").select("token").collect())
    offsets = t.filter((F.col("i") >= 2) & (F.col("i") < 2 + n)).select((F.col("i") - 2).alias("u"), F.col("token").cast("long").alias("lo"))
    bounds = offsets.withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("u")), F.lit(m)))
    ids = bounds.filter("hi > lo").select("u", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("e"))
    targets = t.filter((F.col("i") >= 2 + n) & (F.col("i") < 2 + n + m)).select((F.col("i") - 2 - n).alias("e"), F.col("token").cast("long").alias("v"))
    out = ids.join(targets, "e")
    if weighted:
        out = out.join(t.filter(F.col("i") >= 2 + n + m).select((F.col("i") - 2 - n - m).alias("e"), F.col("token").cast("double").alias("w")), "e")
    return out.select("u", "v", *(["w"] if weighted else []))


def read_triangles(spark: SparkSession, path: str, d: int = 2, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A ``pbbs_triangles`` file -> points (id, x0, ...) and triangles (t, v0, v1, v2), ids less ``offset``."""
    _expect(spark, path, "pbbs_triangles")
    t = tokens(spark, path)
    n, m = (int(r[0]) for r in t.filter("i between 1 and 2").orderBy("i").select("token").collect())
    points = _records(t.filter((F.col("i") >= 3) & (F.col("i") < 3 + n * d)), 3, d)
    corners = _records(t.filter((F.col("i") >= 3 + n * d) & (F.col("i") < 3 + n * d + 3 * m)), 3 + n * d, 3)
    return points, corners.select(F.col("id").alias("t"), *[(F.col(f"x{k}").cast("long") - offset).alias(f"v{k}") for k in range(3)])


def _number(c: str):
    x = F.col(c)
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def write_lines(parts: Sequence[DataFrame], path: str) -> None:
    """One file of the ``value`` columns of all parts in order; each part is sorted by its ``i``. For exchange files; Parquet is the format at scale."""
    every = None
    for k, p in enumerate(parts):
        q = p.select(F.lit(k).alias("__part"), F.col("i").cast("long").alias("i"), "value")
        every = q if every is None else every.unionByName(q)
    every.orderBy("__part", "i").coalesce(1).select("value").write.mode("overwrite").text(path)


def _head(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(str, lines))), "i long, value string")


def write_points(points: DataFrame, dims: Sequence[str], path: str, order: Sequence[str], header: str | None = None) -> None:
    """``N DIM`` (or a header of its own) and one point a line, by ``order``."""
    body = numbered(points, order).select("i", F.concat_ws(" ", *[_number(c) for c in dims]).alias("value"))
    write_lines([_head(points.sparkSession, header or f"{points.count()} {len(dims)}"), body], path)


def write_edges(edges: DataFrame, path: str) -> None:
    weighted = "w" in edges.columns
    names = ["u", "v", "w"][: 3 if weighted else 2]
    body = numbered(edges, names).select("i", F.concat_ws(" ", *[_number(c) for c in names]).alias("value"))
    write_lines([_head(edges.sparkSession, "WeightedEdgeArray" if weighted else "EdgeArray"), body], path)


def write_csr(edges: DataFrame, n: int, path: str) -> None:
    """n, m, the n offsets, targets and, if there are any, weights."""
    spark = edges.sparkSession
    weighted = "w" in edges.columns
    degrees = spark.range(n).select(F.col("id").alias("u")).join(edges.groupBy("u").agg(F.count(F.lit(1)).alias("d")), "u", "left")
    offsets = degrees.select(F.col("u").alias("i"), F.coalesce(F.sum("d").over(Window.orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("string").alias("value"))
    order = ["u", *(["w"] if weighted else []), "v"]
    placed = numbered(edges, order)
    parts = [_head(spark, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph", str(n), str(edges.count())), offsets, placed.select("i", F.col("v").cast("string").alias("value"))]
    write_lines([*parts, *([placed.select("i", _number("w").alias("value"))] if weighted else [])], path)


def write_sequence(rows: DataFrame, path: str, header: str, columns: Sequence[str] = ("value",)) -> None:
    write_lines([_head(rows.sparkSession, header), rows.select("i", F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))], path)


def write_triangles(points: DataFrame, triangles: DataFrame, path: str) -> None:
    dims = [c for c in points.columns if c.startswith("x")]
    head = _head(points.sparkSession, "pbbs_triangles", str(points.count()), str(triangles.count()))
    body = points.select(F.col("id").alias("i"), F.concat_ws(" ", *[_number(c) for c in dims]).alias("value"))
    write_lines([head, body, triangles.select(F.col("t").alias("i"), F.concat_ws(" ", "v0", "v1", "v2").alias("value"))], path)
