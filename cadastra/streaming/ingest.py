"""Resumable ingest with Structured Streaming: new files only, late repeats dropped, counts of open and closed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.sources.folders import shared_folder


def ingest(spark: SparkSession, source: str, schema, key: str, time: str, out: str, state: str, late: str = "1 day") -> None:
    """All new files of a folder (or glob) appended to `out`, each key once within `late`; `state` remembers where it stopped."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def daily_counts(spark: SparkSession, source: str, schema, time: str, by: str, out: str | None = None, state: str | None = None, late: str | None = None, files: int | None = None) -> DataFrame:
    """Counts by day from a stream: every day so far, the open one too, as of all files read by now.

    Each micro-batch writes the counts that it changed under its number, so a batch that runs again writes the same folder
    and the latest number of a day stands; `state` remembers the counts and where the stream stopped. With `late` a day's
    state goes, and rows for it with it, once the watermark has passed its end; without, no row is ever too late. `files`:
    new files in a batch at most.
    """
    out, state = out or shared_folder(spark, "daily"), state or shared_folder(spark, "state")
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    counts = rows.groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), by, "n")

    def save(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # so that there is a table before any row
    counts.writeStream.foreachBatch(save).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day", by).agg(F.max_by("n", "batch").alias("n"))
