"""Reshaping of measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.ln(value)))


def mean_by(rows: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.round(F.avg(v), digits).alias(v) for v in values])


def wide(rows: DataFrame, keys: Sequence[str], column: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column a name; named values need no extra pass to find them."""
    return rows.groupBy(*keys).pivot(column, list(names)).agg(F.first(value))


def long(rows: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return rows.unpivot(list(keys), list(values), name, value)


def bracket(i: Column, *limits: int) -> Column:
    """1 below the first limit, 2 below the second, and so on."""
    out = F.lit(len(limits) + 1)
    for k in range(len(limits), 0, -1):
        out = F.when(i < limits[k - 1], k).otherwise(out)
    return out


def parse_lines(lines: DataFrame, keys: int) -> DataFrame:
    """Lines ``key ... number ...`` as (keys, values), -1 kept for missing."""
    parts = F.split(F.trim("value"), r"[,\s]+")
    return lines.filter(F.trim("value") != "").select(*[parts[i].alias(f"key{i}") for i in range(keys)], F.transform(F.slice(parts, keys + 1, F.size(parts)), lambda x: x.try_cast("double")).alias("values"))


def labelled_groups(lines: DataFrame, order: str, pattern: str) -> DataFrame:
    """Adds ``group`` (blank lines end one) and ``label``, the first capture in the group. For logs, which are small."""
    w = Window.orderBy(order)
    marked = lines.withColumn("group", F.coalesce(F.sum(F.when(F.trim("value") == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    label = F.max(F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))).over(Window.partitionBy("group"))
    return marked.withColumn("label", label)


#: The ratios that the pairs of lines of a balance log stand for, in order.
RATIOS = (1, 1, 2, 3, 4, 5, 6, 10, 20, 30, 40, 45, 46, 47, 48, 49, 50)


def even_lines(lines: DataFrame, order: Sequence[str], labels: Sequence[int] = RATIOS) -> DataFrame:
    """Every second line in a total order, from the second on, headed by its label; those past the last label have none."""
    from plumbline.operators.ordering import numbered

    kept = numbered(lines, order, "__i").filter(F.col("__i") % 2 == 1)
    label = F.get(F.array(*[F.lit(str(x)) for x in labels]), F.floor(F.col("__i") / 2).cast("int"))
    return kept.withColumn("value", F.concat(F.coalesce(label, F.lit("")), F.lit(" "), "value")).drop("__i")


def with_commas(line: Column) -> Column:
    return F.replace(line, F.lit(" "), F.lit(","))


def metric_line(rows: DataFrame, columns: Sequence[str], missing: str = "-1") -> DataFrame:
    """One space-separated line a row."""
    return rows.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]).alias("value"))
