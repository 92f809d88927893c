import pytest
from pyspark.sql import functions as F

from recordloom.config import canonical_schema
from recordloom.operators import dedup, merge, quality
from samples import small_sources

FIELDS = "rec_idx int, parcel_id string, owner_name string, city string, sale_price double, source string, source_url string, extracted_at string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def _pair(spark):
    left = _rows(spark, [(0, "ab-1", "Ann", "Cary", 5.0, "L", "u", "2025-01-01"), (1, "x", "Bo", "", None, "L", "", "1"),
                         (2, "", "Gone", "", None, "L", "", "1"), (3, "  ", "Blank", "", None, "L", "", "1")])
    right = _rows(spark, [(0, " AB-1 ", "Anne", " ", 7.0, "R", "v", "2025-02-01"), (1, "AB-1", "Bob", "Apex", None, "R", None, None),
                          (2, None, "Gone", "", None, "R", "", "1")])
    return left, right


def test_merge_pairs_and_survivorship(spark):
    left, right = _pair(spark)
    got = merge.merge_sources(left, right).orderBy("merge_key", "left_order", "right_order").collect()
    assert [(r.merge_key, r.left_order, r.right_order) for r in got] == [("", 3, None), ("AB-1", 0, 0), ("AB-1", 0, 1), ("X", 1, None)]
    a, b = got[1], got[2]
    assert (a.owner_name, a.city, a.sale_price, a.source, a.source_url, a.extracted_at) == (
        "Anne", "Cary", 5.0, "L + R", "u | v", "2025-02-01")
    assert (b.owner_name, b.city, b.source_url, b.extracted_at) == ("Ann", "Cary", "u", "2025-01-01")
    assert a.is_cross_source_merged and got[3].is_cross_source_merged is None
    assert a.parcel_id == " AB-1 "
    kept = merge.merge_sources(left, right, keep_unkeyed=True)
    assert kept.count() == 6
    pref = merge.merge_sources(left, right, prefer_source="L").filter("right_order = 0").first()
    assert (pref.owner_name, pref.sale_price) == ("Ann", 5.0)
    pref = merge.merge_sources(left, right, prefer_source="R").filter("right_order = 0").first()
    assert (pref.owner_name, pref.sale_price) == ("Anne", 7.0)


def test_merge_accounting(spark):
    left, right = _pair(spark)
    c = merge.merge_counts(left, right).first()
    assert (c.left_only, c.right_only, c.merged, c.total) == (2, 0, 2, 4)
    assert {r.side: r.rows_without_key for r in merge.unkeyed_counts(left, right).collect()} == {"left": 1, "right": 1}
    merged = merge.merge_sources(left, right)
    stats = {(r.section, r.key): r.value for r in merge.merge_statistics(merged).collect()}
    assert stats[("totals", "cross_source_merged")] == 2 and stats[("by_source", "L + R")] == 2
    assert merge.cross_source_only(merged).count() == 2
    assert merge.combine(left, right).count() == 7
    named = left.withColumn("source", F.lit(None).cast("string"))
    assert merge.from_source(named, "Unknown").count() == 4
    empty = merge.merge_statistics(merged.limit(0))
    assert {r.key: r.value for r in empty.collect()}["total_records"] == 0


DUP = "rec_idx int, owner_name string, parcel_id string, property_address string, city string, value double"


def _dups(spark):
    return spark.createDataFrame(
        [
            (0, "John Smith", "ABC", "123 Main St", "", None),
            (1, "John Smith", " abc", "", "Raleigh", 2.0),
            (2, "Jane Doe", "DEF", "456 Oak Ave", "  ", 3.0),
            (3, "John M Smith", "ABC", "9 Elm", "Durham!", 4.0),
            (4, "Zed", "  ", "1 A", "", None),
            (5, "Yak", "  ", "2 B", "", None),
            (6, "No", None, "3 C", "", None),
        ],
        DUP,
    )


def test_exact_groups_and_collapse(spark):
    tagged = dedup.find_duplicates(_dups(spark), use_fuzzy=False)
    assert {r.rec_idx: r.duplicate_group for r in tagged.collect()} == {0: 0, 1: 0, 2: None, 3: 0, 4: None, 5: None, 6: None}
    best = dedup.collapse_groups(tagged).first()
    assert (best.owner_name, best.property_address, best.city, best.value) == ("John M Smith", "123 Main St", "Raleigh", 2.0)
    assert best.is_merged and best.duplicate_count == 3
    first = dedup.collapse_groups(tagged, strategy="first").first()
    assert (first.rec_idx, first.city) == (0, "")
    last = dedup.collapse_groups(tagged, strategy="last").first()
    assert (last.rec_idx, last.city) == (3, "Durham!")
    assert "is_merged" not in dedup.collapse_groups(tagged, strategy="last").columns
    other = dedup.collapse_groups(tagged, strategy="unheard of").first()
    assert other.duplicate_count == 3
    records, members = dedup.deduplicate(_dups(spark), use_fuzzy=False)
    assert (records.count(), members.count()) == (5, 3)
    s = dedup.duplicate_statistics(tagged).first()
    assert (s.total_groups, s.total_duplicates, s.avg_group_size, s.max_group_size, s.min_group_size) == (1, 3, 3.0, 3, 3)
    none = dedup.duplicate_statistics(tagged.filter("false")).first()
    assert (none.total_groups, none.avg_group_size, none.min_group_size) == (0, 0.0, None)


def test_exact_key_of_several_fields(spark):
    tagged = dedup.find_duplicates(_dups(spark), use_fuzzy=False, exact_fields=["owner_name", "value"])
    assert tagged.filter("duplicate_group is not null").count() == 0
    key = dedup.exact_key(_dups(spark), ["parcel_id", "value"])
    got = [r.k for r in _dups(spark).select("rec_idx", key.alias("k")).orderBy("rec_idx").collect()]
    assert got == [None, "ABC|2.0", "DEF|3.0", "ABC|4.0", None, None, None]


def test_mixed_phases_and_pair_scores(spark):
    df = spark.createDataFrame(
        [
            (0, "John Smith", "ABC123", "123 Main St"),
            (1, "John Smith", "ABC123", "123 Main St"),
            (2, "Jane Doe", "DEF456", "456 Oak Ave"),
            (3, "Jane Doe", "", "456 Oak Ave"),
            (4, "Jane Doe", "", ""),
            (5, "John Smith", "", "123 Main St"),
        ],
        "rec_idx int, owner_name string, parcel_id string, property_address string",
    )
    got = {r.rec_idx: (r.duplicate_group, r.duplicate_kind) for r in dedup.find_duplicates(df).collect()}
    assert got == {0: (0, "exact"), 1: (0, "exact"), 2: (2, "fuzzy"), 3: (2, "fuzzy"), 4: (2, "fuzzy"), 5: (None, None)}
    pairs = spark.createDataFrame(
        [("John Smith", "1 A St", "x", "john smith", "", "X"), ("A", "b", "1", None, "b", "2")],
        "l_owner_name string, l_property_address string, l_parcel_id string, r_owner_name string, "
        "r_property_address string, r_parcel_id string",
    )
    a, b = [(r.name_score, r.address_score, r.parcel_score) for r in dedup.pair_scores(pairs).collect()]
    assert a == (100, None, 100.0) and b == (None, 100, 0.0)


def _scored(spark):
    rows = [(i, s) for i, s in enumerate([50.0, 95.0, 80.0, 80.0, None, 10.0, 95.0])]
    df = spark.createDataFrame(rows, "rec_idx bigint, quality_score double")
    return df.withColumn("quality_level", F.when(F.col("quality_score").isNotNull(), quality.level_expr(F.col("quality_score"))))


def test_scores(spark):
    schema = "owner_name string, parcel_id string, assessed_value double, sale_price string, city string"
    df = spark.createDataFrame([("A", "0", 0.0, "0", " "), (None, "", 5.0, None, "x")], schema)
    a, b = quality.score_records(df).collect()
    assert (a.quality_score, a.quality_level, a.completeness_percent) == (40.0, "Low", 27.27)
    assert (b.quality_score, b.completeness_percent) == (15.0, 18.18)
    assert a.enriched_at.startswith("20")
    assert quality.score_records(df, {}).first().completeness_percent == 0.0
    cover = {r.field: (r.filled_count, r.missing_count, r.coverage_percent, r.weight) for r in quality.field_coverage(df).collect()}
    assert cover["owner_name"] == (1, 1, 50.0, 20) and cover["state"] == (0, 2, 0.0, 5)
    assert quality.field_coverage(df.limit(0)).count() == 0


def test_distribution_filter_rank(spark):
    df = _scored(spark)
    d = quality.quality_distribution(df).first()
    assert (d.total_records, d.high_quality, d.medium_quality, d.low_quality) == (7, 4, 1, 1)
    assert (d.high_quality_percent, d.avg_score, d.min_score, d.max_score) == (57.14, 68.33, 10.0, 95.0)
    e = quality.quality_distribution(df.limit(0)).first()
    assert (e.total_records, e.avg_score, e.high_quality_percent) == (0, 0.0, None)
    assert quality.filter_by_quality(df, "Medium").count() == 5
    assert quality.filter_by_quality(df, "Nonsense", 50.0).count() == 5
    order = [1, 6, 2, 3, 0, 5, 4]
    assert [r.rec_idx for r in quality.sort_by_quality(df).collect()] == order
    assert [r.rec_idx for r in quality.sort_by_quality(df, descending=False).collect()] == [4, 5, 0, 2, 3, 1, 6]
    assert [r.rec_idx for r in quality.top_quality(df, 3).collect()] == order[:3]
    places = [F.col("rec_idx"), F.format_string("%05d", "rec_idx"), F.struct(F.lit(None).cast("string").alias("file"), F.col("rec_idx"))]
    for place in places:  # numbers, texts and structs
        ranked = quality.add_rank(df.withColumn("place", place), "place").orderBy("quality_rank").collect()
        assert [r.rec_idx for r in ranked] == order
        assert [r.quality_rank for r in ranked] == list(range(1, 8))
    assert quality.add_rank(df.limit(0)).collect() == []
    bands = [r.b for r in df.select("rec_idx", quality.quality_band(F.col("quality_score")).alias("b")).orderBy("rec_idx").collect()]
    assert bands == ["medium", "high", "high", "high", "low", "low", "high"]


def test_rank_of_one_score(spark):
    df = spark.range(5000).select((F.col("id") * 7).alias("rec_idx"), F.lit(80.0).alias("quality_score"))
    ranked = quality.add_rank(df)
    assert ranked.filter(F.col("quality_rank") != F.col("rec_idx") / 7 + 1).count() == 0


def test_small_sources(spark):
    left, right = small_sources(spark)
    assert left.drop("rec_idx").schema.names == canonical_schema().names == right.drop("rec_idx").schema.names
    assert (left.count(), right.count()) == (10, 5)
    c = merge.merge_counts(left, right).first()
    assert (c.left_only, c.right_only, c.merged, c.total) == (8, 3, 2, 13)
