"""Streams of corpus tables. Nothing here is stateful: expressions run on a streaming
DataFrame as they are, and operators that need a whole batch run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, fmt: str = "parquet") -> DataStreamWriter:
    """A writer that applies an operator to every micro-batch and appends its rows to ``path``,
    under the batch number, so that a batch that is run again replaces its own rows."""
    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")
    return stream.writeStream.foreachBatch(write)
