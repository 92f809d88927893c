"""Records from landed API responses (JSON text)."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.config import canonical_schema
from recordloom.functions.scalars import parse_currency

# --- Fixed values: source field names and constants of the mapping. ---
SOURCE_FIELDS = {
    "owner_name": "OWNER",
    "property_address": "SITE_ADDRESS",
    "city": "CITY",
    "sale_date": "SALE_DATE",
}
KEY_FIELD, KEY_FALLBACK = "PIN_NUM", "REID"
ZIP_FIELD = "ZIPNUM"
MONEY_FIELDS = {"assessed_value": "TOTAL_VALUE_ASSD", "sale_price": "TOTSALPRICE"}
API_SOURCE = "Wake County API"
API_COUNTY = "Wake"
API_STATE = "NC"
# --- End of fixed values. ---


def read_responses(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """Landed response files below ``path``, one row per file (a response is one page
    of a paged service, so its size is bounded); ``file`` names a column for the
    file's path."""
    rows = spark.read.option("recursiveFileLookup", file is not None).text(path, wholetext=True)
    rows = rows.withColumnRenamed("value", "raw")
    return rows if file is None else rows.withColumn(file, F.col("_metadata.file_path"))


def feature_records(responses: DataFrame, raw: str = "raw", at: str | None = None) -> DataFrame:
    """One row per record: the ``attributes`` of each feature that has them, or
    the elements of a bare list; any other shape gives no rows.

    Adds ``record`` (variant) and drops the response text; ``at`` names a column
    for the record's place in its response.
    """
    doc = F.try_parse_json(F.col(raw))
    listed = F.try_variant_get(doc, "$", "array<variant>")
    features = F.try_variant_get(doc, "$.features", "array<variant>")
    attributes = F.filter(
        F.transform(features, lambda f: F.try_variant_get(f, "$.attributes", "variant")), lambda a: a.isNotNull()
    )
    records = F.coalesce(attributes, listed)
    if at is None:
        return responses.withColumn("record", F.explode(records)).drop(raw)
    rest = [F.col(c) for c in responses.columns if c != raw]
    return responses.select(*rest, F.posexplode(records).alias(at, "record"))


def _has(name: str) -> Column:
    return F.try_variant_get("record", f"$.{name}", "variant").isNotNull()


def _text(name: str, absent: Column) -> Column:
    return F.when(_has(name), F.try_variant_get("record", f"$.{name}", "string")).otherwise(absent)


def _money(name: str) -> Column:
    number = F.try_variant_get("record", f"$.{name}", "double")
    return F.coalesce(number, parse_currency(F.try_variant_get("record", f"$.{name}", "string")))


def _kept(name: str, absent: Column) -> Column:
    return F.when(_has(name), F.try_variant_get("record", f"$.{name}", "variant")).otherwise(absent)


def _made_fields(source_url: str, extracted_at: Column | None) -> dict[str, Column]:
    """Fields that the mapping makes itself: amounts as numbers, the ZIP as text, constants."""
    zip_text = F.try_variant_get("record", f"$.{ZIP_FIELD}", "string")
    stamp = extracted_at if extracted_at is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    return {f: _money(s) for f, s in MONEY_FIELDS.items()} | {
        "mailing_address": F.lit(""),
        "state": F.lit(API_STATE),
        "zip_code": F.when(zip_text.isin("0", "", "false"), F.lit("")).otherwise(F.coalesce(zip_text, F.lit(""))),
        "county": F.lit(API_COUNTY),
        "source": F.lit(API_SOURCE),
        "source_url": F.lit(source_url),
        "extracted_at": stamp,
    }


def _canonical(records: DataFrame, fields: dict[str, Column]) -> DataFrame:
    rest = [c for c in records.columns if c != "record"]
    return records.select(*rest, *[fields[f].alias(f) for f in canonical_schema().names])


def map_api_fields(records: DataFrame, source_url: str = "", extracted_at: Column | None = None) -> DataFrame:
    """Source fields to the canonical record. An absent field gives ``""`` and a
    null one stays null; the key falls back only when its field is absent."""
    none = F.lit("")
    fields = {f: _text(s, none) for f, s in SOURCE_FIELDS.items()}
    fields["parcel_id"] = _text(KEY_FIELD, _text(KEY_FALLBACK, none))
    return _canonical(records, fields | _made_fields(source_url, extracted_at))


def map_api_variants(records: DataFrame, source_url: str = "", extracted_at: Column | None = None) -> DataFrame:
    """The same with every field as a variant: what the response said, in the type in
    which it said it, so that validation can judge types. ``typed_records`` gives the
    canonical types afterwards."""
    none = F.lit("").cast("variant")
    fields = {f: _kept(s, none) for f, s in SOURCE_FIELDS.items()}
    fields["parcel_id"] = _kept(KEY_FIELD, _kept(KEY_FALLBACK, none))
    made = {f: c.cast("variant") for f, c in _made_fields(source_url, extracted_at).items()}
    return _canonical(records, fields | made)


def typed_records(df: DataFrame) -> DataFrame:
    """Variant columns of canonical fields in their canonical types; a value that has no such form becomes null."""
    of = {f.name: f.dataType.simpleString() for f in canonical_schema()}
    held = [f.name for f in df.schema.fields if f.name in of and f.dataType.simpleString() == "variant"]
    return df.withColumns({f: F.try_variant_get(F.col(f), "$", of[f]) for f in held})


def fetch(
    df: DataFrame,
    limit: int | None = None,
    offset: int = 0,
    filters: dict[str, str] | None = None,
    order: str | list[str] = "rec_idx",
) -> DataFrame:
    """Rows that equal all filters, from ``offset`` on, at most ``limit``.

    Filters reach the file scan; the limit keeps the top rows per task instead
    of sorting the whole table.
    """
    for k, v in (filters or {}).items():
        df = df.filter(F.col(k) == v)
    if limit is None and not offset:
        return df
    df = df.orderBy(order).offset(offset)
    return df if limit is None else df.limit(limit)


def fetch_and_map(
    responses: DataFrame, limit=None, offset=0, filters=None, order="rec_idx", at: str | None = None, **mapping
) -> DataFrame:
    """Unwrap, map and fetch; ``order`` must be a column of ``responses``. ``at`` names a
    column for a record's place in its response, by which records of one response are ordered."""
    records = map_api_fields(feature_records(responses, at=at), **mapping)
    return fetch(records, limit, offset, filters, order if at is None else [order, at])


def landed_order(file: Column, at: Column) -> Column:
    """Where a record was landed: its file, then its place there. It sorts like the
    records came in, and both sources of a merge have it in the same type."""
    return F.struct(file.cast("string").alias("file"), at.cast("bigint").alias("at"))


def landed_records(spark: SparkSession, path: str, order: str = "landed", as_said: bool = False, **mapping) -> DataFrame:
    """Canonical records of all response files below a path, with their ``order``; ``as_said`` as variants."""
    features = feature_records(read_responses(spark, path, file="_file"), at="_at")
    placed = features.withColumn(order, landed_order(F.col("_file"), F.col("_at"))).drop("_file", "_at")
    return map_api_variants(placed, **mapping) if as_said else map_api_fields(placed, **mapping)


def read_or_empty(
    spark: SparkSession, read: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, str | None]:
    """The source, or an empty canonical frame and the error text, so that one
    source that fails does not stop a run.

    Reading is lazy: only with ``keep``, which writes the rows and gives the written
    table, are errors met that arise while rows are read.
    """
    try:
        df = read()
        return (df if keep is None else keep(df)), None
    except (PySparkException, Py4JJavaError) as e:
        return spark.createDataFrame([], canonical_schema()), str(e)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count records, and those with a name or key, while the scan runs."""
    seen = Observation(name)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    useful = said("owner_name") | said("parcel_id")
    out = df.observe(
        seen,
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(useful).alias("successful_extractions"),
        F.count_if(~useful).alias("failed_extractions"),
    )
    return out, seen
