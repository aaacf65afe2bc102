"""Findings and journals as streams.

A stream of findings is appended to a table without those already in it: every micro-batch
is one anti-join, so a batch that runs again after a failure adds nothing.  A stream of
journal lines keeps the last status of each path in Spark's state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.sinks import insert_absent


def stored(spark, path: str, like: DataFrame) -> DataFrame:
    """The table at a path; empty before the first write."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], like.schema)


def append_new(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Start the append of a stream's rows whose key is not stored yet, all that is there now."""

    def write(batch: DataFrame, _: int) -> None:
        insert_absent(batch, stored(batch.sparkSession, path, batch), keys).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_status(journal: DataFrame, late: str = "1 day") -> DataFrame:
    """The last status of each path in each hour of a stream (path, status, ordinal, ts);
    lines that come later than ``late`` behind the newest are dropped, and state with them."""
    kept = journal.where("status IS NOT NULL").withWatermark("ts", late)
    return kept.groupBy(F.window("ts", "1 hour").alias("w"), "path").agg(F.max_by("status", "ordinal").alias("status"), F.max("ordinal").alias("ordinal")).select(F.col("w.start").alias("hour"), "path", "status", "ordinal")
