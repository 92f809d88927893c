import json

import pytest
from pyspark.sql import functions as F

from recordloom.plans import run as plan
from recordloom.plans.queries import QUERIES
from recordloom.sinks import export, snapshots
from recordloom.sources import pages, responses
from recordloom.sources.selectors import compile_selector, is_path, selectors_for
from recordloom.streaming import landing
from samples import small_sources

DETAIL = """<html><body><div class="owner-info x"><div>skip</div><h3> Ann <b>Lee</b> &amp; Co </h3></div>
<span class="parcel-id"> </span><table><tr><td>Parcel ID</td><td>P-1</td><tr><td>City:</td><td>Cary</table>
<label>Property Address</label><i>x</i><span>1 Elm</span><p>one<p class="zip">two<script>var a="<p>no</p>"</script>
<span class=zip>27601</span><img src="a.png" alt=" Map "></body></html>"""
LISTING = """<table class="search-results"><tbody><tr><td><a href="/d/1">a</a><a href="/no">b</a></td></tr>
<tr><td>no link</td></tr><tr><td><a href="http://h/d/2">c</a></td></tr></tbody></table>"""


def _pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")


def test_page_record(spark):
    df = _pages(spark, ("http://h/d/1", DETAIL), ("http://h/none", "<p>empty"), ("http://h/null", None))
    rows = pages.page_records(df, extracted_at=F.lit("t")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.owner_name, r.parcel_id, r.city, r.property_address, r.zip_code) == ("Ann Lee & Co", "P-1", "Cary", "1 Elm", "27601")
    assert (r.county, r.source_url, r.state, r.extracted_at) == ("Orange", "http://h/d/1", "", "t")


def test_attributes_elements_links(spark):
    df = _pages(spark, ("http://h/s/list?q", DETAIL + LISTING))
    got = pages.extract_attributes(df, {"alt": (["b", "img"], "alt"), "none": (["h9"], "id")}, "-").first()
    assert (got.alt, got.none) == ("Map", "-")
    has = pages.element_exists(df, {"a": "div.owner-info h3", "b": "div.no-results", "c": "//label[contains(text(), 'City')]"}).first()
    assert (has.a, has.b, has.c) == (True, False, False)
    links = pages.page_links(df).orderBy("pos").collect()
    assert [(r.pos, r.link) for r in links] == [(0, "http://h/s/d/1"), (2, "http://h/d/2")]
    assert pages.page_links(df, "http://b/x/search", max_links=1).first().link == "http://b/x/d/1"
    assert pages.page_links(_pages(spark, ("u", "<tr><a href=x>"))).count() == 0


def test_crawl(spark):
    landed = _pages(spark, ("http://h/d/1", DETAIL), ("http://h/d/2", DETAIL.replace("Ann", "Bo")))
    listing = _pages(spark, ("http://h/list", LISTING))
    got = pages.crawl_records(listing, landed, 10, "http://h/list")
    assert [r.owner_name for r in got.collect()] == ["Ann Lee & Co", "Bo Lee & Co"]
    assert pages.crawl_records(listing, landed, 1, "http://h/list").count() == 1
    direct = pages.crawl_records(_pages(spark, ("http://h/x", DETAIL)), landed, 5)
    assert [r.source_url for r in direct.collect()] == ["http://h/x"]


def test_selectors():
    assert selectors_for("owner_name")[-2:] == [
        "//tr[td[contains(text(), 'Owner')]]/td[2]",
        "//div[contains(@class, 'owner')]//text()",
    ]
    assert selectors_for("owner_name") == selectors_for("owner_name")
    assert is_path("//a") and is_path("(//a)") and not is_path("a")
    for f in ("owner_name", "parcel_id", "property_address", "assessed_value", "sale_price"):
        assert all(compile_selector(s) for s in selectors_for(f))
    with pytest.raises(ValueError):
        compile_selector("a > b ~ c::before")


def test_unclosed_elements(spark):
    html = "<table><tr><td>A<td>1<tr><td>B<td>2<table><tr><td>C<td>3</table></table><ul><li>x<ul><li>y</ul><li>z</ul><p>q<div>r"
    fields = {"a": ["td:contains('A') + td"], "c": ["td:contains('C') + td"], "p": ["p"], "d": ["div"], "li": ["ul ul li"]}
    row = pages.extract_texts(_pages(spark, ("u", html)), fields).first()
    assert (row.a, row.p, row.d, row.li) == ("1", "q", "r", "y")
    assert row.c == "3"


def test_path_fallbacks(spark):
    html = "<table><tr><td>Owner of it</td><td>Ann</td></tr></table><div class='the-owner-box'>Box</div>"
    fields = {"a": ["//tr[td[contains(text(), 'Owner')]]/td[2]"], "b": ["//div[contains(@class, 'owner')]//text()"]}
    row = pages.extract_texts(_pages(spark, ("u", html)), fields).first()
    assert (row.a, row.b) == ("Ann", "Box")


def _response(*attributes):
    return json.dumps({"features": [{"attributes": a} if a is not None else {"id": 1} for a in attributes]})


ONE = {"OWNER": "Ann", "PIN_NUM": None, "REID": "R1", "SITE_ADDRESS": "1 Elm", "ZIPNUM": 27601, "TOTAL_VALUE_ASSD": 5, "SALE_DATE": 17}
TWO = {"OWNER": None, "REID": "R2", "ZIPNUM": 0, "TOTSALPRICE": "$1,000"}


def test_responses(spark):
    raw = [(_response(ONE, None, TWO),), (json.dumps([{"OWNER": "List"}]),), ('"text"',), ("not json",)]
    got = responses.fetch_and_map(spark.createDataFrame(raw, "raw string"), source_url="u", extracted_at=F.lit("t"), order="owner_name")
    rows = {r.owner_name: r for r in got.collect()}
    assert len(rows) == 3
    a, b = rows["Ann"], rows[None]
    assert (a.parcel_id, a.zip_code, a.city, a.assessed_value, a.sale_price, a.sale_date) == (None, "27601", "", 5.0, None, "17")
    assert (b.parcel_id, b.zip_code, b.sale_price, b.county, b.state, b.source_url) == ("R2", "", 1000.0, "Wake", "NC", "u")


def test_fetch(spark):
    df = spark.range(20).select(F.col("id").alias("rec_idx"), (F.col("id") % 2).cast("string").alias("c"))
    got = responses.fetch(df, limit=3, offset=2, filters={"c": "1"}).collect()
    assert [r.rec_idx for r in got] == [5, 7, 9]
    assert responses.fetch(df, filters={"c": "0"}).count() == 10


def test_missing_source_is_empty(spark):
    df, error = responses.read_or_empty(spark, lambda: spark.read.parquet("/nowhere/at/all"))
    assert df.isEmpty() and "/nowhere/at/all" in error


def test_observed(spark):
    left, _ = small_sources(spark, 4)
    out, seen = responses.observed(left, "left")
    assert out.count() == 4
    assert seen.get == {"total_records": 4, "successful_extractions": 4, "failed_extractions": 0}


def test_column_order():
    columns = ["zeta", "source", "alpha", "owner_name", "quality_score"]
    assert export.ordered_columns(columns) == ["owner_name", "quality_score", "source", "alpha", "zeta"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(' a "q", b\nc ', 1.5, [1]), (None, None, None)], "owner_name string, x double, y array<int>")
    path = export.write_csv(df, str(tmp_path / "csv"))
    back = export.read_csv(spark, path, export._flat(export.for_export(df)).schema).collect()
    assert {(r.owner_name, r.x, r.y) for r in back} == {(' a "q", b\nc ', 1.5, "[1]"), (None, None, None)}
    assert export.write_csv(df.limit(0), str(tmp_path / "none")) is None
    path = export.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(path).count() == 2
    assert spark.read.json(export.write_raw(df, str(tmp_path / "raw"))).columns == ["owner_name", "x", "y"]
    many = spark.range(25).coalesce(1)
    export.write_json(many, str(tmp_path / "split"), rows_per_file=10)
    assert len(list((tmp_path / "split").glob("part-*"))) == 3
    export.write_by_source(spark.createDataFrame([("s", 1), (None, 2)], "source string, n int"), str(tmp_path / "by"))
    assert (tmp_path / "by" / "source=Unknown").is_dir()
    with pytest.raises(ValueError, match="Unsupported output format"):
        export.export(df, str(tmp_path / "x"), "pdf")


def test_rows_per_file_cleans_once(spark, sf_dir, monkeypatch):
    """Both writers get the rows from a written table, not the job that makes them."""
    read = {}
    for name in ("write_csv", "write_json"):
        write = getattr(export, name)
        monkeypatch.setattr(export, name, lambda df, *a, _n=name, _w=write: (read.update({_n: df.inputFiles()}), _w(df, *a))[1])
    got = QUERIES["rows_per_file"](spark, sf_dir).collect()
    assert {r.format for r in got} == {"csv", "json"} and all(r.within for r in got)
    assert read["write_csv"] == read["write_json"] and all("/cut/" in f for f in read["write_csv"])


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.load_snapshot(spark, "01", root=root) is None
    snapshots.save_snapshot(spark.range(1), "01", "20250101_000000", root)
    snapshots.save_snapshot(spark.range(2), "01", "20250102_000000", root)
    assert snapshots.load_snapshot(spark, "01", root=root).count() == 2
    assert snapshots.load_snapshot(spark, "01", "20250101_000000", root).count() == 1
    assert snapshots.snapshot_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(_response({**ONE, "PIN_NUM": "P1"}, TWO))

    def go():
        q = landing.intake(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out"))

    assert [r.owner_name for r in go().collect()] == ["Ann"]
    (folder / "b.json").write_text(_response({**ONE, "OWNER": "BO, ED"}))
    out = go()
    assert sorted(r.owner_name for r in out.collect()) == ["Ann", "ED BO"]
    batch = landing.prepared(responses.read_responses(spark, str(folder)))
    assert batch.count() == out.count()


@pytest.mark.parametrize("fmt,snaps", [("report", True), ("csv", False)])
def test_whole_run(spark, tmp_path, fmt, snaps):
    left, right = small_sources(spark)
    result = plan.run(spark, {"left": lambda: left, "right": lambda: right}, str(tmp_path / "o"), fmt, snaps)
    assert result.success and result.total_records == 13, result.error
    rows = result.records.collect()
    assert {r.quality_score for r in rows} == {100.0}
    merged = [r for r in rows if r.is_cross_source_merged]
    assert len(merged) == 2 and {r.county for r in merged} == {"Cumberland"}
    stats = {(r.section, r.key): r.value for r in result.statistics.collect()}
    assert stats[("merging", "merged")] == "2" and stats[("deduplication", "duplicate_groups")] == "0"
    if fmt == "report":
        assert sorted(p.name for p in (tmp_path / "o").iterdir()) == sorted(export.REPORT_PARTS)
        sheet = {r.key for r in spark.read.parquet(str(tmp_path / "o" / "statistics")).collect()}
        assert {"Left Only", "Merged", "Duplicate Groups", "Avg Score"} <= sheet
        assert snapshots.load_snapshot(spark, "03_deduplicated", result.run_id).count() == 13


def test_run_with_missing_source_and_failure(spark, tmp_path):
    left, _ = small_sources(spark)
    result = plan.run(spark, {"left": lambda: left, "right": lambda: spark.read.parquet("/nowhere")})
    assert result.success and result.total_records == 10 and "right" in result.source_errors
    bad = plan.run(spark, {"left": lambda: left, "right": lambda: left.limit(0)}, str(tmp_path / "x"), "pdf")
    assert not bad.success and "Unsupported output format" in bad.error


def test_run_keeps_failures_apart(spark, tmp_path):
    left, right = small_sources(spark)
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"PAR1 this is no table PAR1")
    raising = right.withColumn("city", F.when(F.col("rec_idx") > 3, F.raise_error(F.lit("row lost"))).otherwise(F.col("city")))
    for read in (lambda: spark.read.schema(right.schema).parquet(str(broken)), lambda: raising):
        result = plan.run(spark, {"left": lambda: left, "right": read})
        assert result.success and result.total_records == 10 and set(result.source_errors) == {"right"}


def test_run_of_one_source_and_limits(spark):
    left, right = small_sources(spark)
    one = plan.run(spark, {"left": lambda: left})
    assert one.success and one.total_records == 10, one.error
    few = plan.run(spark, {"left": lambda: left, "right": lambda: right}, limits={"left": 3, "right": 1})
    assert few.success and few.total_records == 3, few.error


def test_records_of_one_small_file_are_work_for_all_cores(spark, sf_dir):
    """A table of one row group would be cleaned by one task."""
    from recordloom.sources import adapter

    for made in (adapter.left_records, adapter.right_records, adapter.long_names):
        sizes = [n for n in made(spark, sf_dir).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4
