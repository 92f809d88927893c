"""The folded plan must give what merging and then de-duplicating gives."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordloom.config import CANONICAL_FIELDS, NUMERIC_FIELDS, canonical_schema
from recordloom.operators import dedup, merge
from recordloom.operators.merge import merge_counts, merge_sources
from recordloom.plans import linkage, run
from recordloom.plans.linkage import ORDER
from recordloom.sinks.snapshots import Stages, load_snapshot, snapshot_root
from recordloom.sources import responses


def _records(spark, rng, n, keys, source):
    words = ["", "  ", "A", "Bo", "Cy", "Dora", "Eddy", "Fanny"]
    times = ["2025-01-01T00:00:00", "2025-01-01T00:00:00.000001", "2024-01-01T00:00:00.5", "", "2026"]
    rows = []
    for i in range(n):
        row = {f: rng.choice([*words, None]) for f in CANONICAL_FIELDS}
        row |= {f: rng.choice([None, 0.0, 1.5, float(i)]) for f in NUMERIC_FIELDS}
        row |= {"parcel_id": rng.choice(keys), "extracted_at": rng.choice(times), "source": rng.choice([source, "", source * 2])}
        rows.append((i, *[row[f] for f in CANONICAL_FIELDS]))
    schema = "rec_idx bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in canonical_schema())
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed,hot_rows", [(1, 100_000), (2, 3), (3, 3)])
def test_fold_equals_merge_then_exact_dedup(spark, seed, hot_rows, monkeypatch):
    monkeypatch.setattr(merge, "HOT_KEYS", 4)
    rng = random.Random(seed)
    # One key holds a third of the rows on both sides.
    keys = ["hot", "hot", "hot", "a", " A ", "b", "c", "d", "", "  ", None]
    left, right = _records(spark, rng, 50, keys, "L"), _records(spark, rng, 40, [*keys, "e"], "Right")
    merged = merge_sources(left, right)
    assert sorted(map(str, merged.collect())) == sorted(map(str, merge_sources(left, right, hot_rows=hot_rows).collect()))
    merged = linkage._with_order(merged)
    slow = dedup.deduplicated(dedup.find_duplicates(merged, linkage.ORDER, use_fuzzy=False), linkage.ORDER)
    single, folded = linkage.merge_and_fold(left, right, hot_rows=hot_rows)
    folded = folded.withColumn("duplicate_count", F.col("duplicate_count").cast("bigint"))
    fast = single.unionByName(folded, allowMissingColumns=True)
    columns = sorted(set(slow.columns) - {linkage.ORDER})
    a = sorted(map(str, slow.select(columns).collect()))
    b = sorted(map(str, fast.select(columns).collect()))
    assert a == b
    counts = merge_counts(left, right).first()
    assert counts.total == merged.count()
    assert counts.total == fast.agg(F.sum(F.coalesce("duplicate_count", F.lit(1)))).first()[0]
    members = linkage.exact_members(left, right, hot_rows=hot_rows).count()
    assert members == folded.agg(F.sum("duplicate_count")).first()[0]


def test_sources_of_different_columns(spark):
    left = spark.createDataFrame([(0, "k", "a", "t")], "rec_idx bigint, parcel_id string, city string, extracted_at string")
    right = spark.createDataFrame([(0, "K", "n", "u"), (1, "K", "nn", "t")], "rec_idx bigint, parcel_id string, note string, extracted_at string")
    single, folded = linkage.merge_and_fold(left, right)
    assert single.count() == 0
    row = folded.first()
    assert (row.city, row.note, row.extracted_at, row.duplicate_count) == ("a", "nn", "u", 2)


def test_pair_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(2**40, 2**40), (3, 4)], "l bigint, r bigint")
    got = [r.n for r in df.select(merge.count_of(merge.pair_count(F.col("l"), F.col("r"))).alias("n")).collect()]
    assert got == [2**80, 12]


def test_run_from_landed_files_to_ranks(spark, tmp_path):
    """Two response files, one of them with a bare list, and pages; every record keeps where it was landed."""
    folder = tmp_path / "responses"
    for name, body in {
        "b": [{"OWNER": "B Two", "PIN_NUM": "P2", "SITE_ADDRESS": "2 Oak St"}, {"OWNER": "C Three", "PIN_NUM": "P3", "SITE_ADDRESS": "3 Oak St"}],
        "a": {"features": [{"attributes": {"OWNER": "Z Last", "PIN_NUM": "P9", "SITE_ADDRESS": "9 Oak St"}}, {"id": 1}]},
        "c": "not what was asked for",
    }.items():
        (folder / name).mkdir(parents=True)
        (folder / name / "response.json").write_text(json.dumps(body))
    html = "<div class='owner-info'><h3>B Two</h3></div><span class='parcel-id'>p2</span><div class='property-address'>2 Oak St East</div>"
    pages = spark.createDataFrame([(4, "http://x/4", html), (5, "http://x/5", "<p>none</p>")], "page_id bigint, url string, html string")
    landed = responses.landed_records(spark, str(folder), extracted_at=F.lit("t")).orderBy("landed")
    assert [(r["landed"]["file"].split("/")[-2], r["landed"]["at"], r["parcel_id"]) for r in landed.collect()] == [("a", 0, "P9"), ("b", 0, "P2"), ("b", 1, "P3")]
    result = run.run_landed(spark, str(folder), lambda: pages, extracted_at=F.lit("t"), output_path=str(tmp_path / "out"), output_format="json")
    assert result.success and not result.source_errors and result.total_records == 3
    found = run.ranked(result).orderBy("quality_rank").select("parcel_id", "quality_rank", "is_cross_source_merged").collect()
    assert [(r[0], r[1], r[2]) for r in found] == [("P2", 1, True), ("P3", 2, None), ("P9", 3, None)]
    assert [r["parcel_id"] for r in run.ranked(result, 1).collect()] == ["P2"]
    assert ORDER not in spark.read.json(str(tmp_path / "out")).columns
    # One source that can't be read, or has no readable page, leaves the other one's records.
    alone = run.run_landed(spark, str(tmp_path / "missing"), lambda: pages, extracted_at=F.lit("t"))
    assert alone.success and list(alone.source_errors) == ["responses"] and alone.total_records == 1
    bad = run.run_landed(spark, str(folder), lambda: pages.select(F.raise_error(F.lit("no page")).alias("page_id"), "url", "html"), extracted_at=F.lit("t"))
    assert bad.success and list(bad.source_errors) == ["pages"] and bad.total_records == 3
    with pytest.raises(ValueError):
        run.ranked(run.Result(False, error="nothing"))


def test_a_stopped_run_goes_on_with_its_stages(spark, tmp_path, monkeypatch):
    folder = tmp_path / "source"
    rng = random.Random(3)
    for side in ("left", "right"):
        _records(spark, rng, 60, [f"P{k}" for k in range(12)], side).withColumn("extracted_at", F.lit("t")).withColumn("owner_name", F.lit("A")).withColumn(
            "property_address", F.format_string("%d Oak", "rec_idx")
        ).write.parquet(str(folder / side))
    sources = {side: lambda side=side: spark.read.parquet(str(folder / side)) for side in ("left", "right")}
    cut_tables = lambda: {p.name for p in Path(snapshot_root(spark), "cut").glob("*")}
    before = cut_tables()
    with monkeypatch.context() as m:
        m.setattr(run.quality, "score_records", lambda df: df.select(F.raise_error(F.lit("stopped")).alias("x")))
        stopped = run.run(spark, sources, snapshots=True)
    assert not stopped.success and "stopped" in stopped.error and cut_tables() == before
    assert set(Stages(spark, stopped.run_id).done()) == {"01_fetched_left", "01_fetched_right", "02_cleaned_left", "02_cleaned_right", "03_deduplicated", "03_fuzzy_members"}
    whole = run.run(spark, sources, snapshots=True)
    with monkeypatch.context() as m:
        m.setattr(run, "link", None)  # must not be called again
        m.setattr(run, "prepare", None)
        resumed = run.run(spark, sources, snapshots=True, resume=stopped.run_id)
    assert resumed.success and cut_tables() == before
    same = [c for c in whole.records.columns if c != "enriched_at"]
    assert sorted(map(str, resumed.records.select(same).collect())) == sorted(map(str, whole.records.select(same).collect()))
    timed = lambda r: sorted((x.section, x.key, x.value) for x in r.statistics.collect() if x.section != "run")
    assert timed(resumed) == timed(whole)
    # Other files, or other options, make the stages anew.
    sources["left"]().limit(5).write.mode("append").parquet(str(folder / "left"))
    again = run.run(spark, sources, snapshots=True, resume=stopped.run_id)
    assert again.success and dict((x[1], x[2]) for x in timed(again))["left_total_records"] == str(sources["left"]().count())
    # Without snapshots nothing is left of a run that fails, and of another one after it is dropped.
    bad = run.run(spark, sources, output_path=str(tmp_path / "x"), output_format="none")
    assert not bad.success and not Stages(spark, bad.run_id).done()
    again.drop()
    assert not Stages(spark, again.run_id).done() and load_snapshot(spark, "04_enriched", again.run_id) is None
