"""Documents as they arrive: a stream of files, each batch passed through a batch plan, exactly once into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_stream(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``plan`` over each batch of new Parquet files in ``source`` and write its result under ``target``.

    A batch writes to its own folder, which a repeated batch overwrites; so a restart neither loses nor doubles rows.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
