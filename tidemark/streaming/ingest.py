"""Structured Streaming forms of the batch steps: ingestion with late rows, weekly windows, keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.sinks import Store
from tidemark.schemas import schema


def posts_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Posts from Parquet files as they arrive. created_at is a timestamp here, since watermarks need one."""
    reader = spark.readStream.schema(schema("posts"))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("created_at", F.col("created_at").cast("timestamp"))


def first_copies(stream: DataFrame, late: str = "36 hours") -> DataFrame:
    """The first row of each id within the watermark; state is kept no longer than ``late``."""
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def weekly_counts(stream: DataFrame, by: list[str], late: str = "36 hours") -> DataFrame:
    """Posts and engagement per Saturday-to-Saturday window and ``by``; a window is given out when the watermark passes it."""
    week = F.window("created_at", "7 days", "7 days", "2 days")
    return stream.withWatermark("created_at", late).groupBy(week, *by).agg(F.count(F.lit(1)).alias("posts"), F.sum("engagement").alias("engagement")).select(F.col("window.start").alias("week_start"), *by, "posts", "engagement")


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str, name: str = "posts_upsert") -> StreamingQuery:
    """Each micro-batch through :meth:`Store.upsert_posts`, which may safely be repeated after a failure."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert_posts(batch.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))

    return stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
