"""Validation rules compiled into column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import CANONICAL_FIELDS, FIELD_PATTERNS, NUMERIC_FIELDS, REQUIRED_FIELDS
from recordloom.functions.text import is_blank, strip

# --- Fixed values: type names as they appear in messages. ---
_TEXT = "<class 'str'>"
_INTEGER = "<class 'int'>"
_FLOAT = "<class 'float'>"
_BOOLEAN = "<class 'bool'>"
_LIST = "<class 'list'>"
_OBJECT = "<class 'dict'>"
_MONEY = "(<class 'int'>, <class 'float'>, <class 'NoneType'>)"
# --- End of fixed values. ---

_ALLOWED_IN_MONEY = [_INTEGER, _FLOAT, _BOOLEAN]


def _is_variant(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.VariantType)


def _type_name(df: DataFrame, field: str) -> Column:
    """The type name of each value: per row for variants, else from the schema."""
    dt = df.schema[field].dataType
    if isinstance(dt, T.VariantType):
        kind = F.schema_of_variant(F.col(field))
        return (
            F.when(kind == "STRING", F.lit(_TEXT))
            .when(kind == "BIGINT", F.lit(_INTEGER))
            .when(kind == "BOOLEAN", F.lit(_BOOLEAN))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.lit(_FLOAT))
            .when(kind.startswith("ARRAY"), F.lit(_LIST))
            .when(kind.startswith("OBJECT"), F.lit(_OBJECT))
        )
    if isinstance(dt, T.StringType):
        return F.lit(_TEXT)
    if isinstance(dt, T.BooleanType):
        return F.lit(_BOOLEAN)
    if isinstance(dt, T.IntegralType):
        return F.lit(_INTEGER)
    if isinstance(dt, (T.FractionalType, T.DecimalType)):
        return F.lit(_FLOAT)
    if isinstance(dt, T.ArrayType):
        return F.lit(_LIST)
    return F.lit(_OBJECT)


def _as_text(df: DataFrame, field: str) -> Column:
    if _is_variant(df, field):
        return F.variant_get(F.col(field), "$", "string")
    return F.col(field).cast("string")


def _is_null(df: DataFrame, field: str) -> Column:
    if _is_variant(df, field):
        return F.col(field).isNull() | F.is_variant_null(F.col(field))
    return F.col(field).isNull()


def _is_blank_text(df: DataFrame, field: str) -> Column:
    """True for text that holds nothing but white space."""
    if isinstance(df.schema[field].dataType, T.StringType):
        return F.coalesce(strip(F.col(field)) == "", F.lit(False))
    if _is_variant(df, field):
        is_text = F.schema_of_variant(F.col(field)) == "STRING"
        return F.coalesce(is_text & (strip(_as_text(df, field)) == ""), F.lit(False))
    return F.lit(False)


def _is_present(df: DataFrame, field: str, present: str | None) -> Column:
    """Whether the record has the field at all.

    Without a ``present`` column the frame decides: a missing column is absent.
    With one (an array of key names, as ``json_object_keys`` gives) the row does.
    """
    if field not in df.columns:
        return F.lit(False)
    return F.array_contains(F.col(present), field) if present else F.lit(True)


def _collect(messages: list[Column]) -> Column:
    if not messages:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*messages))


def required_errors(df: DataFrame, fields=REQUIRED_FIELDS, present: str | None = None) -> Column:
    out = []
    for f in fields:
        missing = F.lit(f"Missing required field: {f}")
        if f not in df.columns:
            out.append(missing)
            continue
        empty = _is_null(df, f) | _is_blank_text(df, f)
        out.append(
            F.when(~_is_present(df, f, present), missing).when(empty, F.lit(f"Required field is empty: {f}"))
        )
    return _collect(out)


def type_errors(df: DataFrame, present: str | None = None) -> Column:
    out = []
    for f in CANONICAL_FIELDS:
        if f not in df.columns:
            continue
        name = _type_name(df, f)
        if f in NUMERIC_FIELDS:
            expected, bad = _MONEY, ~name.isin(_ALLOWED_IN_MONEY)
        else:
            expected, bad = _TEXT, name != _TEXT
        message = F.concat(F.lit(f"Field '{f}' has invalid type: expected {expected}, got "), name)
        out.append(F.when(_is_present(df, f, present) & ~_is_null(df, f) & bad, message))
    return _collect(out)


def pattern_errors(df: DataFrame, patterns=FIELD_PATTERNS, present: str | None = None) -> Column:
    out = []
    for f, pattern in patterns.items():
        if f not in df.columns:
            continue
        value = strip(_as_text(df, f))
        skip = _is_null(df, f) | _is_blank_text(df, f)
        message = F.concat(F.lit(f"Field '{f}' does not match required pattern: "), value)
        out.append(F.when(_is_present(df, f, present) & ~skip & ~value.rlike(pattern), message))
    return _collect(out)


def validate(df: DataFrame, strict: bool = False, present: str | None = None) -> DataFrame:
    """Add ``is_valid`` and ``errors``.

    A required-field error makes the row invalid and skips the other rules.
    Otherwise type and pattern errors are listed, and only ``strict`` makes
    them count.
    """
    required = required_errors(df, present=present)
    other = F.concat(type_errors(df, present), pattern_errors(df, present=present))
    out = df.withColumn("_required", required)
    out = out.withColumn("errors", F.when(F.size("_required") > 0, F.col("_required")).otherwise(other))
    decisive = F.col("errors") if strict else F.col("_required")
    return out.withColumn("is_valid", F.size(decisive) == 0).drop("_required")


def split_valid(df: DataFrame, strict: bool = False, present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with their ``errors``."""
    checked = validate(df, strict, present)
    valid = checked.filter("is_valid").drop("is_valid", "errors")
    invalid = checked.filter("not is_valid").drop("is_valid")
    return valid, invalid


def keep_valid(df: DataFrame, strict: bool = False, present: str | None = None) -> DataFrame:
    """Valid rows only; the rules that cannot reject a row are not computed."""
    if strict:
        return split_valid(df, True, present)[0]
    return df.filter(F.size(required_errors(df, present=present)) == 0)


def validate_until_first_error(df: DataFrame, order: str = "rec_idx", strict: bool = False) -> DataFrame:
    """Rows up to and with the first invalid one; rows after it are dropped.

    The cut is one value, taken as a scalar subquery.
    """
    checked = validate(df, strict)
    cut = checked.filter("not is_valid").agg(F.min(order)).scalar()
    return checked.filter(F.coalesce(F.col(order) <= cut, F.lit(True)))


def error_summary(invalid: DataFrame, order: str = "rec_idx", top: int | None = 5) -> DataFrame:
    """Count per error type (the text before the first colon), most common
    first, ties by first occurrence; ``top=None`` gives all of them."""
    each = invalid.select(F.col(order).alias("_ord"), F.posexplode("errors").alias("_pos", "_error"))
    counts = (
        each.withColumn("error_type", strip(F.split_part("_error", F.lit(":"), F.lit(1))))
        .groupBy("error_type")
        .agg(F.count("*").alias("error_count"), F.min(F.struct("_ord", "_pos")).alias("_first"))
        .orderBy(F.desc("error_count"), "_first")
    )
    return (counts if top is None else counts.limit(top)).drop("_first")


def validate_field(
    df: DataFrame, field: str, value: str, check_type: bool = True, check_pattern: bool = True
) -> DataFrame:
    """Check one column as the field ``field``; adds ``is_valid`` and ``errors``."""
    out = []
    if check_type and field in CANONICAL_FIELDS:
        name = _type_name(df, value)
        if field in NUMERIC_FIELDS:
            expected, bad = _MONEY, ~name.isin(_ALLOWED_IN_MONEY)
        else:
            expected, bad = _TEXT, name != _TEXT
        message = F.concat(F.lit(f"Invalid type: expected {expected}, got "), name)
        out.append(F.when(~_is_null(df, value) & bad, message))
    if check_pattern and field in FIELD_PATTERNS:
        shown = strip(_as_text(df, value))
        bad = ~is_blank(_as_text(df, value)) & ~shown.rlike(FIELD_PATTERNS[field])
        out.append(F.when(~_is_null(df, value) & bad, F.concat(F.lit("Does not match required pattern: "), shown)))
    return df.withColumn("errors", _collect(out)).withColumn("is_valid", F.size("errors") == 0)


def has_keys(present: Column, keys: list[str]) -> Column:
    """Whether an array of key names holds all of ``keys``."""
    out = F.lit(True)
    for k in keys:
        out = out & F.array_contains(present, k)
    return out


def validation_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """One row per source: valid and invalid rows (one pass over each)."""
    frames = [
        validate(df).agg(
            F.lit(name).alias("origin"),
            F.count_if("is_valid").alias("valid"),
            F.count_if(~F.col("is_valid")).alias("invalid"),
        )
        for name, df in sources.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def json_records(df: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ("rec_idx",)) -> DataFrame:
    """JSON text to one variant column per record field plus ``present_fields``.

    Types stay per row, and an absent key differs from a null value.
    """
    doc = F.try_parse_json(F.col(raw))
    fields = [F.variant_get(doc, f"$.{f}", "variant").alias(f) for f in CANONICAL_FIELDS]
    return df.select(*keep, *fields, F.json_object_keys(F.col(raw)).alias("present_fields"))
