"""Exports: column order, files, the five-part report, long statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import EXPORT_PRIORITY
from recordloom.functions.text import title

# --- Fixed values: the parts of the report. ---
REPORT_PARTS = ["all_properties", "wake_county", "orange_county", "duplicates", "statistics"]
# --- End of fixed values. ---


# Quotes are doubled, values keep their blanks, and empty text is an empty cell.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def ordered_columns(columns: list[str]) -> list[str]:
    """Priority fields that exist, then the others in alphabetic order."""
    first = [c for c in EXPORT_PRIORITY if c in columns]
    return first + sorted(c for c in columns if c not in first)


def for_export(df: DataFrame) -> DataFrame:
    return df.select(*ordered_columns(df.columns))


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV cannot hold otherwise."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)})


def write_csv(df: DataFrame, path: str, rows_per_file: int = 0) -> str | None:
    """CSV files with a header, in UTF-8; nothing for an empty frame."""
    if df.isEmpty():
        return None
    writer = _flat(for_export(df)).write.mode("overwrite").options(**CSV_OPTIONS)
    writer.option("maxRecordsPerFile", rows_per_file).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read what ``write_csv`` wrote; empty text comes back as null."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str, rows_per_file: int = 0) -> str:
    """JSON lines; nulls are kept as such."""
    writer = for_export(df).write.mode("overwrite").option("ignoreNullFields", False)
    writer.option("maxRecordsPerFile", rows_per_file).json(path)
    return path


def write_raw(df: DataFrame, path: str) -> str:
    """Fetched rows as they came, as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_report(parts: dict[str, DataFrame], path: str, fmt: str = "parquet", rows_per_file: int = 0) -> str:
    """The five parts as named datasets below one path; ``rows_per_file`` > 0
    splits large parts."""
    missing = [p for p in REPORT_PARTS if p not in parts]
    if missing:
        raise ValueError(f"report parts missing: {missing}")
    for name in REPORT_PARTS:
        df = parts[name] if name == "statistics" else for_export(parts[name])
        df = _flat(df) if fmt == "csv" else df
        writer = df.write.mode("overwrite").format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {}))
        writer.option("maxRecordsPerFile", rows_per_file).save(f"{path}/{name}")
    return path


def write_by_source(df: DataFrame, path: str) -> str:
    """One folder per source; a missing source is called ``Unknown``."""
    named = df.withColumn("source", F.coalesce("source", F.lit("Unknown")))
    named.write.mode("overwrite").partitionBy("source").parquet(path)
    return path


def export(records: DataFrame, path: str, output_format: str, parts: dict[str, DataFrame] | None = None):
    """Dispatch on the format: report (of ``parts``), csv or json."""
    if output_format == "report":
        return write_report(parts or {}, path)
    if output_format == "csv":
        return write_csv(records, path)
    if output_format == "json":
        return write_json(records, path)
    raise ValueError(f"Unsupported output format: {output_format}")


def display_name(c: Column) -> Column:
    """``total_records`` as ``Total Records``."""
    return title(F.replace(c, F.lit("_"), F.lit(" ")))


def long_statistics(section: str, wide: DataFrame) -> DataFrame:
    """(section, key, value) from a one-row frame; nested values as JSON text."""
    flat = _flat(wide)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in flat.columns]
    )
    return flat.select(F.explode(pairs).alias("_p")).select(
        F.lit(section).alias("section"), F.col("_p.key").alias("key"), F.col("_p.value").alias("value")
    )


def titled(stats: DataFrame) -> DataFrame:
    """Long statistics with display names."""
    return stats.withColumns({"section": display_name(F.col("section")), "key": display_name(F.col("key"))})


def report_parts(
    records: DataFrame, left: DataFrame, right: DataFrame, duplicates: DataFrame, statistics: DataFrame
) -> dict[str, DataFrame]:
    """The parts by name; the two sources are the cleaned rows before merging."""
    return dict(zip(REPORT_PARTS, [records, left, right, duplicates, titled(statistics)]))

