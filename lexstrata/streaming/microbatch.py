"""Incremental featuring of a document stream: each micro-batch computes only what is missing, then recalibrates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexstrata.operators.score import add_features


def append_features(stream: DataFrame, out: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Append the features of documents (by id) that ``out`` lacks; then call ``after`` with the whole feature table, to score it anew.

    A batch that is run again after a failure adds nothing twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        table = add_features(batch.dropDuplicates(["id"]), out)
        if after:
            after(table)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
