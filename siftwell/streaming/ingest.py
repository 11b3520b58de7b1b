"""Submissions as a stream: each micro-batch goes through the batch operator and becomes the next snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.config import EngineConfig
from siftwell.operators.ingest import ingest
from siftwell.sources.readers import SUBMISSION

STREAM = T.StructType([T.StructField("submission_id", T.LongType()), *SUBMISSION.fields, T.StructField("received_at", T.TimestampType())])


def submissions(spark: SparkSession, folder: str, late: str = "30 days") -> DataFrame:
    """A stream of JSON lines; a submission delivered again within `late` is dropped by its id."""
    return spark.readStream.schema(STREAM).json(folder).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["submission_id"])


def ingest_stream(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, config: EngineConfig | None = None):
    """Starts the query. load() gives the current snapshot; save(decisions, snapshot, batch_id) stores the next one and must be idempotent by batch_id."""

    def one(batch: DataFrame, batch_id: int) -> None:
        decisions, after = ingest(batch.drop("received_at"), load(), config)
        save(decisions, after, batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def channel_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Submissions by page and tumbling window of received_at, late rows kept up to the watermark."""
    return stream.withWatermark("received_at", late).groupBy(F.window("received_at", window).alias("w"), "page_url").count()
