"""The event engine on a stream of files: each micro-batch is one batch of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commerce_spark.plans.lakehouse import EVENTS, Lakehouse


def run(spark: SparkSession, engine: Lakehouse, folder: str, checkpoint: str, cutoff: str = "2026-09-30", files_a_batch: int = 1) -> None:
    """Process what is new in `folder` (JSON lines) and stop.

    Events are known by their id, so a batch that comes again, after a crash or by another stream over the same files,
    changes no table; no mark of batches is needed, and streams with checkpoints of their own can share a store.
    """

    def take(df: DataFrame, batch_id: int) -> None:
        engine.process(df, cutoff)

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).option("mode", "FAILFAST").json(folder)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
