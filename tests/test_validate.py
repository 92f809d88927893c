from pyspark.sql import functions as F

from recordloom.operators import validate as v

BASE = "rec_idx int, owner_name string, property_address string, source string, extracted_at string"


def _frame(spark, rows, schema=BASE):
    return spark.createDataFrame(rows, schema)


def test_required_fields(spark):
    df = _frame(spark, [(0, "A", "1 Main", "s", "t"), (1, "", "1 Main", "s", "t"), (2, "A", None, " ", "t")])
    rows = v.validate(df).orderBy("rec_idx").collect()
    assert [r.is_valid for r in rows] == [True, False, False]
    assert rows[2].errors == ["Required field is empty: property_address", "Required field is empty: source"]
    missing = v.validate(df.drop("source")).orderBy("rec_idx").first()
    assert missing.errors == ["Missing required field: source"]


def test_types_per_row(spark):
    raw = [
        (0, '{"owner_name": 5, "property_address": "a", "source": "s", "extracted_at": "t"}'),
        (1, '{"owner_name": "A", "property_address": "a", "source": "s", "extracted_at": "t", "sale_price": ""}'),
        (2, '{"owner_name": "A", "property_address": "a", "source": "s", "extracted_at": "t", "sale_price": true}'),
        (3, '{"owner_name": null, "property_address": "a", "source": "s"}'),
    ]
    df = v.json_records(spark.createDataFrame(raw, "rec_idx int, raw string"))
    rows = v.validate(df, strict=True, present="present_fields").orderBy("rec_idx").collect()
    assert rows[0].errors == ["Field 'owner_name' has invalid type: expected <class 'str'>, got <class 'int'>"]
    assert rows[1].errors == [
        "Field 'sale_price' has invalid type: expected (<class 'int'>, <class 'float'>, <class 'NoneType'>), "
        "got <class 'str'>"
    ]
    assert rows[2].is_valid
    assert rows[3].errors == ["Required field is empty: owner_name", "Missing required field: extracted_at"]


def test_patterns_strict_and_not(spark):
    rows = [(0, "A", "a", "s", "t", "1234"), (1, "A", "a", "s", "t", " 12345 "), (2, "A", "a", "s", "t", " ")]
    df = _frame(spark, rows, BASE + ", zip_code string")
    loose = v.validate(df).orderBy("rec_idx").collect()
    assert [r.is_valid for r in loose] == [True, True, True]
    assert loose[0].errors == ["Field 'zip_code' does not match required pattern: 1234"]
    assert [r.is_valid for r in v.validate(df, strict=True).orderBy("rec_idx").collect()] == [False, True, True]
    assert v.keep_valid(df, strict=True).count() == 2


def test_single_field(spark):
    cases = {"12345": True, "12345-6789": True, "1234": False, "abc": False, None: True}
    df = spark.createDataFrame([(x,) for x in cases], "z string")
    got = {r.z: (r.is_valid, r.errors) for r in v.validate_field(df, "zip_code", "z").collect()}
    assert {k: x[0] for k, x in got.items()} == cases
    assert got["1234"][1] == ["Does not match required pattern: 1234"]
    assert v.validate_field(spark.range(1), "owner_name", "id").first().errors == [
        "Invalid type: expected <class 'str'>, got <class 'int'>"
    ]


def test_stop_at_first_error(spark):
    df = _frame(spark, [(0, "A", "a", "s", "t"), (1, "", "a", "s", "t"), (2, "A", "a", "s", "t")])
    assert [r.rec_idx for r in v.validate_until_first_error(df).orderBy("rec_idx").collect()] == [0, 1]
    good = df.filter("rec_idx <> 1")
    assert v.validate_until_first_error(good).count() == 2


def test_summary(spark):
    rows = [(0, ["B: x", "A: y"]), (1, ["A: z"]), (2, ["C", "B: q"]), (3, ["D"]), (4, ["E"]), (5, ["F"])]
    df = spark.createDataFrame(rows, "rec_idx int, errors array<string>")
    got = [(r.error_type, r.error_count) for r in v.error_summary(df).collect()]
    assert got == [("B", 2), ("A", 2), ("C", 1), ("D", 1), ("E", 1)]
    assert v.error_summary(df, top=None).count() == 6


def test_has_keys_and_counts(spark):
    df = spark.createDataFrame([(["a", "b"],)], "p array<string>")
    row = df.select(v.has_keys(F.col("p"), ["a"]).alias("x"), v.has_keys(F.col("p"), ["a", "c"]).alias("y")).first()
    assert (row.x, row.y) == (True, False)
    good = _frame(spark, [(0, "A", "a", "s", "t"), (1, "", "a", "s", "t")])
    got = {r.origin: (r.valid, r.invalid) for r in v.validation_counts({"l": good, "r": good.limit(0)}).collect()}
    assert got == {"l": (1, 1), "r": (0, 0)}
