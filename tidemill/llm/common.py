"""Helpers that the corpus operators share: scratch tables and size-checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.scratch import scratch, shared_dir, written

__all__ = ["scratch", "shared_dir", "written"]

#: A word, as the contracts have it: a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table, in rows, that a join may broadcast; wider rows need a smaller bound.
BROADCAST_ROWS = 200_000


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``rows``, a measured or proven count of ``df``, is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def with_row(df: DataFrame, *names: str) -> DataFrame:
    """The whole row as a struct ``_row``, and the named columns beside it.

    Operators that hand on their input's rows work on this form, so that no column
    of the input can clash with one of theirs; ``select("_row.*")`` gives it back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{n}`").alias(n) for n in names])


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """The first column of each of the names, by exact name; other columns go.

    Tables may carry extra columns, some with names that an operator uses itself.
    """
    return df.select(*[F.col(f"`{n}`") for n in names])


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with _n, a number from zero up among those that agree in the keys (no nulls).

    One value may hold a large share of all rows, so they are numbered within the
    tasks that wrote them, and each task's numbers go on where those of the one
    before ended.  Only one count per value and task meets in a window.
    """
    held = written(rows.withColumn("_part", F.spark_partition_id()), "numbered-rows")
    counts = held.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(*keys, "_part", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_start")), "number-starts")
    own = held.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1)
    return own.join(maybe_broadcast(starts, starts.count()), [*keys, "_part"]).select(*rows.columns, (F.col("_start") + F.col("_own")).alias("_n"))
