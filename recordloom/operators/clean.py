"""Cleaning: projections over the fields that are present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.functions.scalars import parse_currency

# Which kind of value each field holds; the kinds have their steps in ``text``.
KINDS = {
    "owner_name": "owner_name",
    "property_address": "address",
    "mailing_address": "address",
    "city": "city",
    "state": "state",
    "zip_code": "zip_code",
}


def apply_steps(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Run the steps of each column's kind, the n-th steps of all together."""
    steps = {f: text.STEPS[k] for f, k in kinds.items()}
    for n in range(max((len(s) for s in steps.values()), default=0)):
        df = df.withColumns({f: s[n](F.col(f)) for f, s in steps.items() if n < len(s)})
    return df


def clean_records(df: DataFrame) -> DataFrame:
    """Normalise names, addresses, city, state and ZIP; other columns pass.

    A column that holds no text gives ``""``, as a value that is no text does.
    """
    types = dict(df.dtypes)
    present = {f: k for f, k in KINDS.items() if f in types}
    no_text = {f: F.lit("") for f in present if types[f] != "string"}
    return apply_steps(df, {f: k for f, k in present.items() if f not in no_text}).withColumns(no_text)


def trim_text_columns(df: DataFrame) -> DataFrame:
    """Trim every text column; blank stays ``""`` and other types pass."""
    return df.withColumns({f: text.strip(F.col(f)) for f, t in df.dtypes if t == "string"})


def coerce_money(df: DataFrame, fields: list[str]) -> DataFrame:
    """Text amounts to doubles, so that later stages see one type per field."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            f: parse_currency(F.col(f)) if types[f] == "string" else F.col(f).cast("double")
            for f in fields
            if f in types
        }
    )
