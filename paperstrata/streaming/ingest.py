"""Incremental ingest: new files of a folder replace their collections' partitions, batch by batch, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import replace_partitions


def ingest(spark: SparkSession, source: str, schema: str, target: str, by: str, checkpoint: str) -> StreamingQuery:
    """Reads the Parquet files that came since the last run and stops. A batch that is run again overwrites the same partitions."""

    def write(batch: DataFrame, _: int) -> None:
        replace_partitions(batch, target, by)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
