"""Session settings that the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan on real sizes; split skewed partitions, also where that costs a shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Comparing texts costs far more than reading them: keep small partitions apart.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    # Pages can be large: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder, **more: str) -> SparkSession.Builder:
    """Add the settings to a session builder; ``more`` wins."""
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder
