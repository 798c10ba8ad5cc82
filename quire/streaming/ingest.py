"""Ingest as a stream of files: the batch functions run unchanged.

Nothing here keeps state; a stream only bounds how much is read at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.papers import ingest_filter, project_papers
from quire.schemas import RAW_PAPER


def stream_papers_json(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RAW_PAPER)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def ingest_stream(raw: DataFrame, dimension: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Filter the records that have arrived and append them to a Parquet table."""
    return (
        ingest_filter(project_papers(raw), dimension)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
