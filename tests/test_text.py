"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions import scalars
from recordloom.operators.clean import apply_steps, clean_records, coerce_money, trim_text_columns

NAMES = {
    "SMITH, JOHN": "John Smith",
    "SMITH, JOHN MICHAEL": "John Michael Smith",
    "Smith Family Trust": "Smith Family TRUST",
    "ABC Properties L.L.C.": "ABC Properties L.L.C.",
    "XYZ Corporation Inc.": "XYZ Corporation Inc.",
    "FOO L L C": "FOO LLC",
    "FOO L L C TRUST": "FOO L L C TRUST",
    "RALPH, JOHN": "Ralph, John",
    "LEE, JOE": "JOE LEE",
    "O'BRIEN & SONS": "O'Brien & Sons",
    "  Extra   Spaces  ": "Extra Spaces",
    "jOhN sMiTh": "John Smith",
    "john  smith\t2nd": "John Smith 2Nd",
    "josé núñez": "José Núñez",
    ", JOHN": "John",
    "a,b,c": "b,c a".title(),
    "": "",
    "   ": "",
    None: "",
}
ADDRESSES = {
    "123 Main Street": "123 MAIN ST",
    "456 Oak Avenue": "456 OAK AVE",
    "789 North Elm Road": "789 N ELM RD",
    "100 South East Park Drive": "100 S E PARK DR",
    "123  Main   Street": "123 MAIN ST",
    "9 Westlake Courtyard": "9 WESTLAKE COURTYARD",
    "1 Place, Court": "1 PL, CT",
    "   ": "",
    None: "",
}
CITIES = {"chapel hill": "Chapel Hill", "RALEIGH": "Raleigh", "winston-salem": "Winston-Salem", " ": "", None: ""}
STATES = {"nc": "NC", "North Carolina": "NC", "Texas": "TE", "NCA": "NC", " virginia ": "VA", "": "", None: ""}
ZIPS = {
    "12345": "12345",
    "123": "00123",
    "12345-6789": "12345-6789",
    "123456789": "12345-6789",
    "12345 6789": "12345-6789",
    "27514-12": "27514-1200",
    "N/A": "00000",
    "1-2-3": None,
    "1234567": "12345",
    "1234567-123456": "1234567-1234",
    "-27601-": "27601",
    "": "",
    None: "",
}


def _apply(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.c for r in apply_steps(df, {"c": kind}).orderBy("i").collect()]


@pytest.mark.parametrize(
    "kind,cases",
    [("owner_name", NAMES), ("address", ADDRESSES), ("city", CITIES), ("state", STATES), ("zip_code", ZIPS)],
)
def test_cleaning(spark, kind, cases):
    assert dict(zip(cases, _apply(spark, kind, cases))) == cases


def test_clean_record_leaves_other_columns(spark):
    df = spark.createDataFrame([("DOE, JANE", 5, "keep ")], "owner_name string, zip_code int, note string")
    row = clean_records(df).first()
    assert (row.owner_name, row.zip_code, row.note) == ("Jane DOE", "", "keep ")


def test_trim_and_money(spark):
    df = spark.createDataFrame([(" a\t", "$1,200.5", 3)], "a string, sale_price string, assessed_value int")
    row = coerce_money(trim_text_columns(df), ["sale_price", "assessed_value"]).first()
    assert (row.a, row.sale_price, row.assessed_value) == ("a", 1200.5, 3.0)


def _column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.o for r in df.select("i", fn(F.col("c")).alias("o")).orderBy("i").collect()]


def test_parse_currency(spark):
    cases = {"$1,234.56": 1234.56, "1234.56": 1234.56, "1_000": 1000.0, "1d": None, "": None, "x": None, None: None, "-3e2": -300.0}
    assert _column(spark, cases, scalars.parse_currency) == list(cases.values())


def test_parse_date(spark):
    cases = {
        "2024-01-15": "2024-01-15",
        "1/5/2024": "2024-01-05",
        "01-15-2024": "2024-01-15",
        "15/01/2024": "2024-01-15",
        "2024/1/5": "2024-01-05",
        "january 5, 2024": "2024-01-05",
        " Jan 5, 2024 ": "2024-01-05",
        "2024-13-01": None,
        "soon": None,
        None: None,
    }
    assert _column(spark, cases, scalars.parse_date) == list(cases.values())
    assert _column(spark, ["05.01.2024"], lambda c: scalars.parse_date(c, ["dd.MM.yyyy"])) == ["2024-01-05"]


def test_truncate_default_hash(spark):
    assert _column(spark, ["a" * 10, "abc", None], lambda c: scalars.truncate(c, 8)) == ["aaaaa...", "abc", None]
    assert _column(spark, [" ", None, "x"], lambda c: scalars.value_or(c, F.lit("d"))) == ["d", "d", "x"]
    import hashlib

    want = hashlib.md5(b"ab|").hexdigest()
    assert _column(spark, [" AB "], lambda c: scalars.record_hash(c, F.lit(None).cast("string"))) == [want]
