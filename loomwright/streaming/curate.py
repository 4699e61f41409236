"""Micro-batch forms: events once each, running totals, and pages as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.dialect import SPARK
from loomwright.operators import catalog
from loomwright.session import shared_dir


def _stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A table as a file stream: a folder of part files by its own path, a single file by its name."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def new_events(spark: SparkSession, sf_dir: str, late: str = "365 days") -> DataFrame:
    """The event ids of a file stream, each once. State is bounded by the watermark: an event that
    comes more than `late` after the newest one is dropped."""
    stream = _stream(spark, sf_dir, "events")
    out = f"{shared_dir(spark)}/loomwright/stream-{uuid.uuid4().hex}"
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    query = once.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(out)


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by event type, merged batch after batch (foreachBatch); one file a trigger."""
    stream = _stream(spark, sf_dir, "events", maxFilesPerTrigger=1)
    out = f"{shared_dir(spark)}/loomwright/stream-{uuid.uuid4().hex}"

    def merge(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        part.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # an epoch that runs again replaces its own rows

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def new_pages(spark: SparkSession, sf_dir: str, least: int = 10, files: int = 100) -> DataFrame:
    """Pages as they arrive, a chunk of files a batch: rows with enough words, written by the batch;
    a batch that runs again replaces its own rows."""
    out = f"{shared_dir(spark)}/loomwright/stream-{uuid.uuid4().hex}"

    def curate(batch: DataFrame, epoch: int) -> None:
        batch.createOrReplaceGlobalTempView("stream_pages")
        made = catalog.page_rows(SPARK).replace("FROM pages", "FROM global_temp.stream_pages")
        rows = batch.sparkSession.sql(f"SELECT page_id, words FROM ({made}) p WHERE words >= {least}")
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = _stream(spark, sf_dir, "pages", maxFilesPerTrigger=files).writeStream.foreachBatch(curate).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("page_id", "words")
