"""Streams of requests: every micro-batch is one published batch, named by its number, so a repeat adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources import schemas


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Requests from JSON-lines files as they appear."""
    return spark.readStream.schema(schemas.REQUEST).option("maxFilesPerTrigger", files_a_batch).json(path)


def write_stream(engine: Engine, requests: DataFrame, checkpoint: str, name: str = "requests", available_now: bool = True) -> StreamingQuery:
    """Feed ``engine`` from a stream. After each batch, a search sees exactly what has been published."""

    def take(batch: DataFrame, number: int) -> None:
        engine.add(batch, batch=f"{name}-{number}")

    writer = requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def revisions(requests: DataFrame) -> DataFrame:
    """Accepted requests of each user, kept up to date over a stream (update mode)."""
    return requests.groupBy("user_id").agg(F.count("*").alias("revision"))


def activity(messages: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Messages of each user by event-time window; rows later than ``late`` are not waited for."""
    at = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return messages.withWatermark("event_time", late).groupBy("user_id", at.alias("w")).agg(F.count("*").alias("messages")).select("user_id", "w.start", "w.end", "messages")
