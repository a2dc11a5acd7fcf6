"""Sinks of the workflow tables: an append-only event log and create-once rows, in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources.scratch import written


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a Parquet log; earlier files are never touched."""
    rows.write.mode("append").parquet(path)


def create(rows: DataFrame, held: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Appends the rows whose key is new, the first of each key by ``order``; what became of every offered row.

    Ties in ``order`` go by the whole row, and what is told was written before it is
    told.  One batch writes at a time: files have no unique index to race on.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order, whole)) == 1
    known = held.select(key).distinct().withColumn("_known", F.lit(True))
    told = rows.withColumn("_first", first).join(known, key, "left")
    told = told.withColumn("outcome", F.when(F.col("_known").isNull() & F.col("_first"), "created").otherwise("exists")).drop("_known", "_first")
    told = written(told, "created")
    append(told.where("outcome = 'created'").drop("outcome"), path)
    return told


def stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there now of a stream, appended exactly once to a Parquet log."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
