"""Small made-up sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.config import CANONICAL_FIELDS, canonical_schema


def _record(i: int, **given) -> tuple:
    plain = {
        "owner_name": f"Mira Okafor {i}",
        "parcel_id": f"LOT-{i}",
        "property_address": f"{10 + i} Quarry Ln",
        "mailing_address": f"PO Box {i}",
        "city": "Fairmont",
        "state": "NC",
        "zip_code": "28340",
        "county": "Robeson",
        "assessed_value": 90000.0 + 500 * i,
        "sale_date": "2023-06-30",
        "sale_price": 95000.0 + 500 * i,
        "source": "register",
        "source_url": "https://records.example.org",
        "extracted_at": "2025-03-01T08:00:00",
    } | given
    return (i, *[plain[f] for f in CANONICAL_FIELDS])


def small_sources(spark: SparkSession, left_rows: int = 10, right_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two sources whose first two keys are shared; the rest is unique."""
    schema = "rec_idx bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in canonical_schema())
    left = [_record(i) for i in range(left_rows)]
    # A county with a longer name wins; a field that is empty on one side is filled from the other.
    far = {"county": "Cumberland", "source": "clerk pages"}
    right = [
        _record(i, **far, mailing_address="") if i < 2
        else _record(i, **far, owner_name=f"Ana Petrov {i}", parcel_id=f"TRACT-{i}", property_address=f"{700 + i} Mill Pond Rd", city="Hope Mills")
        for i in range(right_rows)
    ]
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
