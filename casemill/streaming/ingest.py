"""Continuous ingest of complaint requests (an extension: requests come one by one otherwise)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casemill.functions.schemas import REQUESTS
from casemill.plans.ingest import audit_rows, complaint_rows


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Request files as they arrive, with the time they were read; the schema is fixed, so nothing is inferred."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(path).where(F.col("text").isNotNull()).withColumn("received_at", F.current_timestamp())


def start(requests: DataFrame, out: str, checkpoint: str, once: bool = False, **plugins) -> StreamingQuery:
    """Extracts each batch and appends it to both tables under `out`.

    A batch that is tried again after a failure is written to the same place: its folder is named
    by its number and overwritten, so both tables hold each batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = complaint_rows(batch, F.col("received_at"), **plugins)
        rows.write.mode("overwrite").parquet(f"{out}/complaints/batch={number}")
        audit_rows(batch.sparkSession.read.parquet(f"{out}/complaints/batch={number}")).write.mode("overwrite").parquet(f"{out}/audit_logs/batch={number}")

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def daily_counts(complaints: DataFrame, late: str = "1 day") -> DataFrame:
    """Complaints by day and class over a stream of rows, late ones within the watermark counted."""
    return complaints.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "crime_type").agg(F.count(F.lit(1)).alias("total"))


