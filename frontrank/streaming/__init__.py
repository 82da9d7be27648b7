"""Ranking of fronts as they arrive: the batch operators on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def rank_stream(fronts: DataFrame, rank: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch holds whole fronts (a producer writes a front in one file); it is ranked and appended once.

    Batches are written under their number, so a batch that is repeated after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        rank(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = fronts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
