"""Rules, weights and fixed values shared by all stages."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: field names, weights, thresholds, patterns and word lists. ---

CANONICAL_FIELDS = [
    "owner_name",
    "parcel_id",
    "property_address",
    "mailing_address",
    "city",
    "state",
    "zip_code",
    "county",
    "assessed_value",
    "sale_date",
    "sale_price",
    "source",
    "source_url",
    "extracted_at",
]

NUMERIC_FIELDS = ["assessed_value", "sale_price"]

REQUIRED_FIELDS = ["owner_name", "property_address", "source", "extracted_at"]

FIELD_PATTERNS = {
    "zip_code": r"^\d{5}(-\d{4})?$",
    "parcel_id": r"^[A-Z0-9\-]+$",
    "state": r"^[A-Z]{2}$",
}

QUALITY_WEIGHTS = {
    "owner_name": 20,
    "parcel_id": 15,
    "property_address": 15,
    "mailing_address": 10,
    "city": 5,
    "state": 5,
    "zip_code": 5,
    "county": 5,
    "assessed_value": 10,
    "sale_date": 5,
    "sale_price": 5,
}

QUALITY_HIGH = 80
QUALITY_MEDIUM = 50

EXACT_MATCH_FIELDS = ["parcel_id"]
NAME_THRESHOLD = 90
ADDRESS_THRESHOLD = 95

ENTITY_SUFFIXES = ["LLC", "CORP", "INC", "TRUST", "LP", "LLP", "CO"]
COMPANY_MARKERS = ["LLC", "CORP", "INC", "TRUST", "LP", "LLP"]

STREET_ABBREVIATIONS = {
    "STREET": "ST",
    "AVENUE": "AVE",
    "BOULEVARD": "BLVD",
    "DRIVE": "DR",
    "ROAD": "RD",
    "LANE": "LN",
    "COURT": "CT",
    "CIRCLE": "CIR",
    "PLACE": "PL",
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
}

STATE_CODES = {
    "NORTH CAROLINA": "NC",
    "SOUTH CAROLINA": "SC",
    "VIRGINIA": "VA",
    "GEORGIA": "GA",
    "TENNESSEE": "TN",
}

EXPORT_PRIORITY = [
    "owner_name",
    "parcel_id",
    "property_address",
    "city",
    "state",
    "zip_code",
    "county",
    "mailing_address",
    "assessed_value",
    "sale_date",
    "sale_price",
    "quality_score",
    "quality_level",
    "completeness_percent",
    "source",
    "source_url",
    "extracted_at",
]

# --- End of fixed values. ---

LEVEL_ORDER = {"Low": 0, "Medium": 1, "High": 2}


def canonical_schema() -> T.StructType:
    """The 14 record fields: text, but for the two money fields."""
    return T.StructType(
        [
            T.StructField(f, T.DoubleType() if f in NUMERIC_FIELDS else T.StringType())
            for f in CANONICAL_FIELDS
        ]
    )
