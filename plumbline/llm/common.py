"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the white space that ends a word: space and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows may be broadcast once it has been counted.
BROADCAST_ROWS = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def in_training(doc_id: Column) -> Column:
    """True for rows that a model may learn from: crc32 of the id as text, mod 5, is not 0. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. A local session, as in tests, may go without; a cluster may not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that neither a lost executor nor a long lineage repeats the work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its counted rows are within ``limit``; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def paths(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(paths(sf_dir, name))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 25) -> None:
    """At most so many rows and bytes (of all rows but the last) in an Arrow batch, so that very long texts don't meet in one.

    Batches are cut when a plan runs, so this lowers the session's own settings; it never raises them.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
        if not 0 < int(number) << " kmgt".index(unit or " ") * 10 <= most:
            spark.conf.set(name, str(most))


_remembering: dict[str, Callable[[], None]] = {}


def alone_in_worker(name: str, forget: Callable[[], None]) -> None:
    """Called where an operator starts in a Python worker: what other operators still remember there is dropped."""
    for other, drop in _remembering.items():
        if other != name:
            drop()
    _remembering[name] = forget
