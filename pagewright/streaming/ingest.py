"""Incremental ingest of pages and events with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.pages import main_text


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", max_files: int = 100) -> DataFrame:
    """New page files as they come, each URL once, as clean valid text."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    told = raw.dropDuplicates(["url"]).withColumn("text", main_text(F.col("html"))).drop("html")
    return told.where(T.is_valid_content(F.col("text")))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take in all that is there, append it to ``out``, and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def distinct_events(spark: SparkSession, path: str, key: str, work: str) -> DataFrame:
    """Distinct values of ``key`` by a streaming pass over a table; the final state."""
    schema = spark.read.parquet(path).schema
    # as a pattern, a table of one file is as good a source as a folder
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    out, at = f"{work}/{uuid.uuid4().hex}", f"{work}/{uuid.uuid4().hex}"
    run_once(stream.select(key).dropDuplicates([key]), out, at)
    return spark.read.parquet(out)
