"""Streaming forms: 60-second windows over transcripts and events, and incremental ingestion.

The engine this one stands in for has windows over stored transcripts only; watermarks and streams are an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import chat, ingest


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, length: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out, closed windows are dropped from the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def ingest_stream(listing: DataFrame, rows_of: Callable[[], DataFrame], process: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of a document listing is planned against the store; only changed documents are processed.

    ``write`` gets the new rows and the batch's number, so that a repeated batch can overwrite its own output.
    """

    def one(batch: DataFrame, number: int) -> None:
        plan = ingest.incremental_plan(rows_of(), batch)
        write(process(plan.where(F.col("action") == "process")), number)

    return listing.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_signature(spark: SparkSession, folder: str) -> DataFrame:
    """One row that changes with any file of a store: for readers that reload on change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("newest"))


def chat_log(messages: DataFrame, path: str, checkpoint: str, delay: str = "1 hour"):
    """Messages of a stream are appended to the tables under ``path``, with their session and sources, each once.

    Repeats within ``delay`` are dropped by the stream's state, older ones and those of a replayed batch by an
    anti-join with what is stored. Sources go first and messages last, so a batch that was cut off is
    finished when it comes again. ``id`` tells messages apart.
    """
    spark = messages.sparkSession
    table = lambda name, ddl: spark.read.schema(ddl).parquet(f"{path}/{name}")

    def one(batch: DataFrame, number: int) -> None:
        for name, ddl in (("sessions", schemas.SESSION), ("messages", schemas.MESSAGE), ("sources", schemas.MESSAGE_SOURCE)):
            schemas.conform(batch.limit(0), ddl).write.mode("ignore").parquet(f"{path}/{name}")
        rows = chat.insert_or_ignore(schemas.conform(batch, schemas.MESSAGE), table("messages", schemas.MESSAGE), ("id",), ("created_at", "session_id", "content")).persist()
        try:
            cited = chat.source_rows(rows).withColumn("id", F.lit(None).cast("bigint")).dropDuplicates(["message_id", "doc_name", "doc_path"])
            known = table("sources", schemas.MESSAGE_SOURCE)
            chat.insert_or_ignore(cited, known, ("message_id", "doc_name", "doc_path")).select("id", "message_id", "doc_name", "doc_path").write.mode("append").parquet(f"{path}/sources")
            opened = rows.groupBy("session_id").agg(F.min("created_at").alias("created_at"))
            chat.insert_or_ignore(opened, table("sessions", schemas.SESSION), ("session_id",)).write.mode("append").parquet(f"{path}/sessions")
            rows.write.mode("append").parquet(f"{path}/messages")
        finally:
            rows.unpersist()

    timed = messages.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    return timed.dropDuplicatesWithinWatermark(["id"]).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
