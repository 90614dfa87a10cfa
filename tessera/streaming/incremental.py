"""Incremental resolution: each micro-batch of pool records is matched against a fixed reference table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_stream(pool: DataFrame, s1: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that writes the matches of every batch below ``path``, by batch, so that a repeated batch replaces its own.

    match: (s1, new pool records) -> matches."""

    def batch(new: DataFrame, epoch: int) -> None:
        match(s1, new).withColumn("batch", F.lit(epoch)).write.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path, mode="overwrite")

    return pool.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
