"""Keeping an index up to date with a table that files are streamed into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodegram.plans.index import Indexes


def append_and_refresh(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, root: str | None = None) -> StreamingQuery:
    """Append each micro-batch of the stream to the table and index it.

    A batch that runs again after a failure may be appended again (at least once); the index only ever names
    files that are there, and rows not indexed yet are found by the tail scan.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows.write.mode("append").parquet(path)
        Indexes(spark, root).refresh(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_in_steps(spark: SparkSession, path: str, max_rows: int, root: str | None = None) -> int:
    """Bounded refreshes, each published, until nothing is left; the number of steps."""
    steps = 0
    while True:
        progress = Indexes(spark, root).refresh(path, max_rows).collect()
        steps += 1
        if not any(r.remaining_tail for r in progress):
            return steps
