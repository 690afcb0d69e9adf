"""Restartable ingestion (STR-1 to STR-3): Structured Streaming with a checkpoint and one row per id."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracemill.sources.ledger import BUCKETS, append_batch


def ingest(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id", kind: str = "json", files_per_trigger: int = 1000, buckets: int = BUCKETS) -> StreamingQuery:
    """Reads new files, transforms them, appends rows whose id isn't in the ledger yet; ends when there are no more files.

    A micro-batch is a batch of the ledger, named by the checkpoint's query and its number, so one that died half way is
    replaced when the stream goes on. With a new checkpoint all is read again and nothing is appended twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(source)

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        append_batch(transform(batch).dropDuplicates([key]), sink, key, f"{query}-{number}", buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
