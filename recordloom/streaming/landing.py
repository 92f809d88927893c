"""Incremental intake: landed response files, read as they arrive.

The row-wise stages (map, validate, clean, score) need no other row, so they run
unchanged on a stream of files. The checkpoint of the query records which files
are done, and a restarted run goes on after them: the resume that a long fetch
needs. Merging and de-duplication compare all rows and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators import clean, quality, validate
from recordloom.sources.responses import feature_records, map_api_fields


def landed_responses(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Response files of a folder as a stream, one row per file."""
    reader = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).withColumnRenamed("value", "raw")


def prepared(responses: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """Scored records of valid rows; works on batch and streaming frames."""
    records = map_api_fields(feature_records(responses), extracted_at=extracted_at)
    return quality.score_records(clean.clean_records(validate.keep_valid(records)), timestamp=False)


def intake(spark: SparkSession, folder: str, output: str, checkpoint: str) -> StreamingQuery:
    """Process all files that have arrived since the last run, then stop."""
    writer = prepared(landed_responses(spark, folder)).writeStream.format("parquet")
    return (
        writer.option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
