"""One query per operator, over records derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.config import CANONICAL_FIELDS
from recordloom.functions import scalars, text
from recordloom.operators import clean, dedup, documented, merge, quality, validate
from recordloom.plans import run as plan
from recordloom.plans.linkage import ORDER
from recordloom.sinks import export
from recordloom.sinks.snapshots import cut, load_snapshot, new_run_id, save_snapshot, snapshot_root
from recordloom.sources import adapter, pages, responses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _left(spark, sf_dir) -> DataFrame:
    return adapter.left_records(spark, sf_dir)


def _right(spark, sf_dir) -> DataFrame:
    return adapter.right_records(spark, sf_dir)


def _all(spark, sf_dir) -> DataFrame:
    return adapter.all_records(spark, sf_dir)


def _counted(df: DataFrame) -> DataFrame:
    """Counts as BIGINT for comparison; one beyond its range fails."""
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() == "decimal(38,0)"]
    return df.withColumns({c: F.col(c).cast("bigint") for c in wide})


def _prepared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return plan.prepare(_left(spark, sf_dir)), plan.prepare(_right(spark, sf_dir))


def _prepared_all(spark, sf_dir) -> DataFrame:
    return plan.prepare(_all(spark, sf_dir))


def _scored(spark, sf_dir) -> DataFrame:
    return quality.score_records(_prepared_all(spark, sf_dir), timestamp=False)


def _joined_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", F.array_join("errors", " | "))


# --- scalar functions ---


def _cleaned(spark, sf_dir, *fields: str) -> DataFrame:
    return clean.clean_records(_all(spark, sf_dir).select("rec_idx", *fields))


@query
def clean_names(spark, sf_dir):
    return _cleaned(spark, sf_dir, "owner_name")


@query
def clean_addresses(spark, sf_dir):
    return _cleaned(spark, sf_dir, "property_address", "mailing_address")


@query
def clean_city_state(spark, sf_dir):
    return _cleaned(spark, sf_dir, "city", "state")


@query
def clean_zip(spark, sf_dir):
    return _cleaned(spark, sf_dir, "zip_code")


@query
def clean_records(spark, sf_dir):
    return clean.clean_records(_all(spark, sf_dir))


@query
def trim_text_columns(spark, sf_dir):
    return clean.trim_text_columns(_all(spark, sf_dir))


@query
def match_keys(spark, sf_dir):
    return _all(spark, sf_dir).select("rec_idx", text.match_key(F.col("parcel_id")).alias("match_key"))


@query
def record_hash(spark, sf_dir):
    fields = ["owner_name", "parcel_id", "property_address", "sale_date"]
    return _all(spark, sf_dir).select("rec_idx", scalars.record_hash(*[F.col(f) for f in fields]).alias("record_hash"))


@query
def document_hash(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.record_hash(F.col("text"), F.col("lang"), F.col("source")).alias("record_hash"))


@query
def hash_numbers(spark, sf_dir):
    rows = _all(spark, sf_dir)
    fields = ["parcel_id", "assessed_value", "sale_price"]
    types = [rows.schema[f].dataType for f in fields]
    return rows.select("rec_idx", scalars.record_hash(*map(F.col, fields), types=types).alias("record_hash"))


@query
def parse_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    shown = F.date_format(d, "yyyy-MM-dd")
    for n, p in enumerate(["MM/dd/yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MMMM dd, yyyy", "MMM dd, yyyy"]):
        shown = F.when(F.col("o_orderkey") % 8 == n, F.date_format(d, p)).otherwise(shown)
    shown = F.when(F.col("o_orderkey") % 8 == 7, F.concat(F.lit("on "), shown)).otherwise(shown)
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", scalars.parse_date(shown).alias("order_date"))


@query
def parse_currency(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    whole = F.floor("o_totalprice").cast("bigint").cast("string")
    shown = F.concat(F.lit(" $"), F.regexp_replace(whole, r"(\d)(\d{3})$", "$1,$2"), F.lit(".25"))
    shown = F.when(F.col("o_orderkey") % 11 == 0, "N/A").when(F.col("o_orderkey") % 7 == 0, whole).otherwise(shown)
    return orders.select("o_orderkey", scalars.parse_currency(shown).alias("price"))


@query
def truncate_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.truncate(F.col("text"), 100).alias("short_text"))


@query
def value_or_default(spark, sf_dir):
    return _all(spark, sf_dir).select(
        "rec_idx", scalars.value_or(F.col("property_address"), F.lit("unknown")).alias("property_address")
    )


# --- validation ---


@query
def validate_rows(spark, sf_dir):
    return _joined_errors(validate.validate(_all(spark, sf_dir))).select("rec_idx", "is_valid", "errors")


@query
def validate_strict(spark, sf_dir):
    return _joined_errors(validate.validate(_all(spark, sf_dir), strict=True)).select("rec_idx", "is_valid", "errors")


@query
def valid_only(spark, sf_dir):
    return validate.keep_valid(_all(spark, sf_dir))


@query
def invalid_rows(spark, sf_dir):
    return _joined_errors(validate.split_valid(_all(spark, sf_dir), strict=True)[1]).select("rec_idx", "errors")


@query
def error_summary(spark, sf_dir):
    return validate.error_summary(validate.split_valid(_all(spark, sf_dir), strict=True)[1])


@query
def stop_on_error(spark, sf_dir):
    backwards = _left(spark, sf_dir).withColumn("rec_idx", -F.col("rec_idx"))
    return validate.validate_until_first_error(backwards).select("rec_idx", "is_valid")


@query
def validation_counts(spark, sf_dir):
    return validate.validation_counts({"left": _left(spark, sf_dir), "right": _right(spark, sf_dir)})


def raw_json(k: str = "rec_idx") -> str:
    """Records as JSON text with absent, null and wrongly typed values."""
    return (
        f"""'{{"owner_name": ' || CASE {k} % 31 WHEN 0 THEN CAST({k} AS STRING) WHEN 1 THEN 'null' """
        f"""WHEN 2 THEN '["a"]' ELSE '"' || owner_name || '"' END || ', "property_address": "' || property_address """
        f"""|| '"' || CASE WHEN {k} % 41 = 0 THEN '' ELSE ', "source": "' || source || '"' END || """
        f"""', "extracted_at": "' || extracted_at || '", "zip_code": ' || CASE {k} % 7 WHEN 0 THEN '27601' """
        f"""WHEN 1 THEN '" "' ELSE '"' || zip_code || '"' END || ', "assessed_value": ' || CASE {k} % 37 """
        f"""WHEN 0 THEN '"N/A"' WHEN 1 THEN 'true' WHEN 2 THEN 'null' WHEN 3 THEN '1.5' """
        f"""ELSE CAST({k} AS STRING) END || '}}'"""
    )


@query
def validate_json_types(spark, sf_dir):
    raw = _all(spark, sf_dir).select("rec_idx", F.expr(raw_json()).alias("raw"))
    checked = validate.validate(validate.json_records(raw), strict=True, present="present_fields")
    return _joined_errors(checked).select("rec_idx", "is_valid", "errors")


@query
def validate_field(spark, sf_dir):
    out = validate.validate_field(_all(spark, sf_dir), "zip_code", "zip_code")
    return _joined_errors(out).select("rec_idx", "is_valid", "errors")


@query
def has_keys(spark, sf_dir):
    present = F.json_object_keys("props")
    return _table(spark, sf_dir, "events").select(
        "event_id",
        validate.has_keys(present, ["k"]).alias("has_k"),
        validate.has_keys(present, ["k", "v"]).alias("has_both"),
    )


# --- sources ---


def _responses(spark, sf_dir) -> DataFrame:
    """Response pages of up to 200 features, built from the left records."""
    attributes = F.struct(
        F.col("owner_name").alias("OWNER"),
        F.when(F.col("rec_idx") % 5 != 0, F.col("parcel_id")).alias("PIN_NUM"),
        F.concat(F.lit("R"), F.col("rec_idx").cast("string")).alias("REID"),
        F.col("property_address").alias("SITE_ADDRESS"),
        F.col("city").alias("CITY"),
        F.when(F.col("rec_idx") % 3 == 0, 0).otherwise(27601).alias("ZIPNUM"),
        F.floor("assessed_value").cast("bigint").alias("TOTAL_VALUE_ASSD"),
        F.when(F.col("rec_idx") % 4 != 0, F.col("rec_idx") + 1700000000).alias("SALE_DATE"),
    )
    feature = F.struct(F.col("rec_idx").alias("id"), F.when(F.col("rec_idx") % 31 != 0, attributes).alias("attributes"))
    left = _left(spark, sf_dir).select("rec_idx", F.floor(F.col("rec_idx") / 200).alias("page"), F.to_json(feature).alias("f"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rec_idx", "f"))), lambda x: x["f"])
    joined = F.concat(F.lit('{"features": ['), F.array_join(in_order, ", "), F.lit("]}"))
    return left.groupBy("page").agg(joined.alias("raw"))


def _property_pages(spark, sf_dir) -> DataFrame:
    """A page of HTML for every right record."""
    cells = {
        "parcel-id": F.col("parcel_id"), "city": F.col("city"), "state": F.col("state"), "zip": F.col("zip_code"),
        "assessed-value": F.when(F.col("assessed_value") > 0, F.concat(F.lit("$"), F.floor("assessed_value").cast("string"))),
        "sale-date": F.col("sale_date"),
    }
    parts = [F.lit('<html><body><div class="owner-info"><h3>'), F.col("owner_name"), F.lit("</h3></div>")]
    for name in ("property_address", "mailing_address"):
        parts += [F.lit(f'<div class="{name.replace("_", "-")}">'), F.col(name), F.lit("</div>")]
    for name, value in cells.items():
        parts += [F.lit(f'<span class="{name}">'), F.coalesce(value, F.lit("")), F.lit("</span>")]
    html = F.concat(*parts, F.lit("</body></html>"))
    url = F.concat(F.lit("https://b.example/p/"), F.col("rec_idx").cast("string"))
    return _right(spark, sf_dir).select(F.col("rec_idx").alias("page_id"), url.alias("url"), html.alias("html"))


def _landed_responses(spark, sf_dir) -> str:
    """The responses as files, one each, in folders whose names sort like the pages."""
    folder = _run_folder(spark, "landed")
    rows = _responses(spark, sf_dir).select(F.lpad(F.col("page").cast("string"), 12, "0").alias("response"), F.col("raw").alias("value"))
    rows.write.partitionBy("response").text(folder)
    return folder


@query
def response_features(spark, sf_dir):
    got = responses.feature_records(_responses(spark, sf_dir))
    return got.select("page", F.variant_get("record", "$.REID", "string").alias("reid"))


@query
def response_records(spark, sf_dir):
    got = responses.feature_records(_responses(spark, sf_dir))
    return responses.map_api_fields(got, "https://a.example", F.lit("2025-01-01T00:00:00")).drop("page")


_OWNER, _CITY = '"OWNER":"[^"]*"', '"CITY":"[^"]*"'


def _odd_responses(spark, sf_dir) -> DataFrame:
    """Responses with numbers and lists for texts, nulls, and absent fields."""
    k = F.col("rec_idx")
    left = _left(spark, sf_dir).select(
        "rec_idx", F.floor(k / 200).alias("page"),
        F.to_json(F.struct(
            F.col("owner_name").alias("OWNER"), F.col("parcel_id").alias("PIN_NUM"), F.concat(F.lit("R"), k.cast("string")).alias("REID"),
            F.col("property_address").alias("SITE_ADDRESS"), F.col("city").alias("CITY"), F.lit(27601).alias("ZIPNUM"),
        )).alias("a"),
    )
    a = F.when(k % 7 == 1, F.regexp_replace("a", F.lit(_OWNER), F.concat(F.lit('"OWNER":'), k.cast("string")))).otherwise(F.col("a"))
    left = left.withColumn("a", a)
    left = left.withColumn("a", F.when(k % 11 == 2, F.regexp_replace("a", _CITY, '"CITY":["x"]')).otherwise(F.col("a")))
    left = left.withColumn("a", F.when(k % 13 == 3, F.regexp_replace("a", '"SITE_ADDRESS":"[^"]*"', '"SITE_ADDRESS":null')).otherwise(F.col("a")))
    left = left.withColumn("a", F.when(k % 17 == 4, F.regexp_replace("a", '"OWNER":("[^"]*"|[0-9]+),', "")).otherwise(F.col("a")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rec_idx", "a"))), lambda x: F.concat(F.lit('{"attributes":'), x["a"], F.lit("}")))
    return left.groupBy("page").agg(F.concat(F.lit('{"features": ['), F.array_join(in_order, ", "), F.lit("]}")).alias("raw"))


def _as_said(spark, sf_dir) -> DataFrame:
    records = responses.feature_records(_odd_responses(spark, sf_dir))
    records = records.withColumn("reid", F.variant_get("record", "$.REID", "string"))
    return responses.map_api_variants(records, "https://a.example", F.lit("2025-01-01T00:00:00"))


@query
def validate_responses(spark, sf_dir):
    """Types as the response said them, judged by the strict rules."""
    return _joined_errors(validate.validate(_as_said(spark, sf_dir), strict=True)).select("reid", "is_valid", "errors")


@query
def typed_responses(spark, sf_dir):
    """The valid ones in their canonical types."""
    return responses.typed_records(validate.keep_valid(_as_said(spark, sf_dir), strict=True)).drop("page")


@query
def fetch_and_map(spark, sf_dir):
    got = responses.fetch_and_map(
        _responses(spark, sf_dir), 50, 20, {"city": "RALEIGH"}, "page", at="at", source_url="https://a.example", extracted_at=F.lit("2025-01-01T00:00:00")
    )
    return got.drop("page", "at")


@query
def fetch_page(spark, sf_dir):
    return responses.fetch(_left(spark, sf_dir), limit=50, offset=20, filters={"city": "RALEIGH"})


PAGE_FIELDS = {
    "heading": ["h2.none", "article h1", "title"],
    "first_link": ["nav a", "a"],
    "language": ["td:contains('Language') + td", "//label[contains(text(), 'Language')]/following-sibling::span"],
    "footer": ["footer"],
}


@query
def page_texts(spark, sf_dir):
    return pages.extract_texts(_table(spark, sf_dir, "pages"), PAGE_FIELDS)


@query
def page_attributes(spark, sf_dir):
    wanted = {"first_target": (["table a", "nav a"], "href"), "language": (["html"], "lang")}
    return pages.extract_attributes(_table(spark, sf_dir, "pages"), wanted).drop("url")


@query
def page_elements(spark, sf_dir):
    wanted = {"has_nav": "nav ul li", "has_ad": "div.ad", "has_table": "table.search-results"}
    return pages.element_exists(_table(spark, sf_dir, "pages"), wanted).drop("url")


@query
def page_links(spark, sf_dir):
    return pages.page_links(_table(spark, sf_dir, "pages"), rows="nav li", max_links=4, tables=["nav"]).drop("url")


@query
def page_records(spark, sf_dir):
    wanted = {"owner_name": ["h2", "h1"], "parcel_id": ["span.parcel-id"], "property_address": ["div.ad"], "city": ["nav a"]}
    got = pages.page_records(_table(spark, sf_dir, "pages"), wanted, extracted_at=F.lit("2025-01-01T00:00:00"))
    return got.select("page_id", "owner_name", "parcel_id", "city", "state", "county", "source", "source_url", "extracted_at")


def _listings(landed: DataFrame) -> DataFrame:
    """Result lists of up to 20 links, built from the pages' own urls."""
    row = F.struct("page_id", F.concat(F.lit("<tr><td><a href='"), "url", F.lit("'>x</a></td></tr>")).alias("h"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["h"]), "")
    return landed.groupBy(F.floor(F.col("page_id") / 20).alias("page_id")).agg(
        F.lit("http://list.example/search").alias("url"),
        F.concat(F.lit('<table class="search-results"><tbody>'), rows, F.lit("</tbody></table>")).alias("html"),
    )


@query
def crawl_records(spark, sf_dir):
    """Result lists of up to 20 links, built from the pages' own urls."""
    landed = _table(spark, sf_dir, "pages")
    listing = _listings(landed)
    wanted = {"owner_name": ["h1"], "parcel_id": ["span.parcel-id"], "city": ["nav a"]}
    got = pages.crawl_records(listing, landed, 100, selectors=wanted, links_per_listing=10)
    return got.select("page_id", "owner_name", "city", "source_url")


@query
def crawl_all(spark, sf_dir):
    """All links of all result lists, without limits."""
    landed = _table(spark, sf_dir, "pages")
    wanted = {"owner_name": ["h1"], "parcel_id": ["span.parcel-id"], "city": ["nav a"]}
    got = pages.crawl_all(_listings(landed), landed, selectors=wanted, extracted_at=F.lit("2025-01-01T00:00:00"))
    return got.select("listing", "pos", "page_id", "owner_name", "city", "source_url")


@query
def observed_counts(spark, sf_dir):
    """Counters of a source, taken while its rows are written."""
    rows = []
    for name, df in (("left", _left(spark, sf_dir)), ("right", _right(spark, sf_dir))):
        emptied = df.withColumns({c: F.when(F.col("rec_idx") % 19 != 0, F.col(c)) for c in ("owner_name", "parcel_id")})
        counted, seen = responses.observed(emptied, f"counts_{name}_{new_run_id()}")
        cut(counted, "counted")
        rows.append((name, *(seen.get[k] for k in ("total_records", "successful_extractions", "failed_extractions"))))
    return spark.createDataFrame(rows, "origin string, total_records bigint, successful_extractions bigint, failed_extractions bigint")


@query
def source_counts(spark, sf_dir):
    rows = _all(spark, sf_dir)
    return rows.groupBy("source").agg(F.count("*").alias("total_records"))


# --- merging ---


@query
def merge_sources(spark, sf_dir):
    return merge.merge_sources(*_prepared(spark, sf_dir))


@query
def merge_preferring_source(spark, sf_dir):
    return merge.merge_sources(*_prepared(spark, sf_dir), prefer_source="Wake County API")


@query
def merge_keeping_unkeyed(spark, sf_dir):
    return merge.merge_sources(*_prepared(spark, sf_dir), keep_unkeyed=True)


@query
def merge_counts(spark, sf_dir):
    return _counted(merge.merge_counts(*_prepared(spark, sf_dir)))


@query
def unkeyed_counts(spark, sf_dir):
    return merge.unkeyed_counts(*_prepared(spark, sf_dir))


@query
def merge_statistics(spark, sf_dir):
    return _counted(merge.pair_statistics(*_prepared(spark, sf_dir)))


@query
def cross_source_only(spark, sf_dir):
    return merge.cross_source_only(merge.merge_sources(*_prepared(spark, sf_dir)))


@query
def records_of_source(spark, sf_dir):
    return merge.from_source(_all(spark, sf_dir), "Orange County Scraper")


@query
def combine_records(spark, sf_dir):
    return merge.combine(_left(spark, sf_dir), _right(spark, sf_dir))


# --- duplicates ---


@query
def exact_groups(spark, sf_dir):
    tagged = dedup.find_duplicates(_prepared_all(spark, sf_dir), use_fuzzy=False)
    return tagged.select("rec_idx", "duplicate_group", "duplicate_kind")


def _exact(spark, sf_dir) -> DataFrame:
    return dedup.find_duplicates(_prepared_all(spark, sf_dir), use_fuzzy=False)


@query
def exact_merged(spark, sf_dir):
    return dedup.deduplicate(_prepared_all(spark, sf_dir), use_fuzzy=False)[0]


@query
def collapse_most_complete(spark, sf_dir):
    return dedup.collapse_groups(_exact(spark, sf_dir))


@query
def collapse_first(spark, sf_dir):
    return dedup.collapse_groups(_exact(spark, sf_dir), strategy="first")


@query
def collapse_last(spark, sf_dir):
    return dedup.collapse_groups(_exact(spark, sf_dir), strategy="last")


@query
def unique_rows(spark, sf_dir):
    return _exact(spark, sf_dir).filter("duplicate_group is null").select("rec_idx")


@query
def exact_statistics(spark, sf_dir):
    return dedup.duplicate_statistics(_exact(spark, sf_dir))


@query
def pair_scores(spark, sf_dir):
    left, right = _prepared(spark, sf_dir)
    pairs = documented.joined_sources(left, right).filter("data_source = 'merged'")
    scored = dedup.pair_scores(pairs)
    return scored.select("l_rec_idx", "r_rec_idx", "name_score", "address_score", "parcel_score")


@query
def fuzzy_pairs(spark, sf_dir):
    return dedup.fuzzy_pairs(_prepared_all(spark, sf_dir))


@query
def fuzzy_long_names(spark, sf_dir):
    """Names of 60 to 120 symbols without an address: the name decides alone."""
    return dedup.fuzzy_pairs(adapter.long_names(spark, sf_dir))


@query
def fuzzy_groups(spark, sf_dir):
    tagged = dedup.find_duplicates(_prepared_all(spark, sf_dir), use_exact=False)
    return tagged.select("rec_idx", "duplicate_group", "duplicate_kind")


@query
def find_duplicates(spark, sf_dir):
    tagged = dedup.find_duplicates(_prepared_all(spark, sf_dir))
    return tagged.select("rec_idx", "duplicate_group", "duplicate_kind")


@query
def deduplicate(spark, sf_dir):
    return dedup.deduplicate(_prepared_all(spark, sf_dir))[0]


@query
def duplicate_members(spark, sf_dir):
    return dedup.deduplicate(_prepared_all(spark, sf_dir))[1]


@query
def duplicate_statistics(spark, sf_dir):
    return dedup.duplicate_statistics(dedup.find_duplicates(_prepared_all(spark, sf_dir)))


# --- quality ---


@query
def score_records(spark, sf_dir):
    return _scored(spark, sf_dir).select("rec_idx", "quality_score", "quality_level", "completeness_percent")


@query
def quality_distribution(spark, sf_dir):
    return quality.quality_distribution(_scored(spark, sf_dir))


@query
def field_coverage(spark, sf_dir):
    return quality.field_coverage(_prepared_all(spark, sf_dir))


@query
def filter_quality(spark, sf_dir):
    return quality.filter_by_quality(_scored(spark, sf_dir), "Medium", 85.0).select("rec_idx", "quality_score")


@query
def sort_quality(spark, sf_dir):
    return quality.sort_by_quality(_scored(spark, sf_dir)).select("rec_idx", "quality_score")


@query
def top_quality(spark, sf_dir):
    return quality.top_quality(_scored(spark, sf_dir), 10).select("rec_idx", "owner_name", "quality_score")


@query
def quality_rank(spark, sf_dir):
    return quality.add_rank(_scored(spark, sf_dir)).select("rec_idx", "quality_score", "quality_rank")


# --- sinks ---


def _run_folder(spark, name: str) -> str:
    return f"{snapshot_root(spark)}/{name}/{new_run_id()}"


@query
def export_csv(spark, sf_dir):
    rows = export.for_export(_scored(spark, sf_dir))
    return export.read_csv(spark, export.write_csv(rows, _run_folder(spark, "csv")), rows.schema)


@query
def export_json(spark, sf_dir):
    rows = export.for_export(_scored(spark, sf_dir))
    return spark.read.schema(rows.schema).json(export.write_json(rows, _run_folder(spark, "json")))


@query
def rows_per_file(spark, sf_dir):
    """Files of at most 100 rows each, in both formats."""
    # Cleaning costs more than the files, and each writer and the look whether there are rows would do it again.
    rows = cut(export.for_export(_scored(spark, sf_dir)), "scored")
    written = {"csv": export.write_csv(rows, _run_folder(spark, "csv"), 100), "json": export.write_json(rows, _run_folder(spark, "json"), 100)}
    out = []
    for fmt, path in written.items():
        table = export.read_csv(spark, path, rows.schema) if fmt == "csv" else spark.read.schema(rows.schema).json(path)
        files = table.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
        out.append(files.agg(F.lit(fmt).alias("format"), F.sum("n").alias("rows"), (F.max("n") <= 100).alias("within")))
    return out[0].unionByName(out[1])


@query
def raw_rows(spark, sf_dir):
    """Fetched rows as they came, written and read again."""
    rows = _left(spark, sf_dir)
    return spark.read.schema(rows.schema).json(export.write_raw(rows, _run_folder(spark, "raw")))


@query
def report_parts(spark, sf_dir):
    """The five parts of a run's report, read again: rows, and texts by their total length."""
    folder = _run_folder(spark, "report")
    _run(spark, sf_dir, output_path=folder, output_format="report")
    out = []
    for part in export.REPORT_PARTS:
        table = spark.read.parquet(f"{folder}/{part}")
        texts = ["section", "key"] if part == "statistics" else ["owner_name", "parcel_id", "property_address"]
        size = F.coalesce(F.sum(sum((F.length(F.coalesce(c, F.lit(""))) for c in texts), F.lit(0))), F.lit(0))
        out.append(table.agg(F.lit(part).alias("part"), F.count("*").alias("rows"), size.cast("bigint").alias("text_size")))
    return reduce(DataFrame.unionByName, out)


@query
def export_formats(spark, sf_dir):
    """Dispatch by format; an unknown one is refused."""
    rows = _scored(spark, sf_dir)
    out = []
    for fmt in ("csv", "json", "xml"):
        try:
            path = export.export(rows, _run_folder(spark, fmt), fmt)
            table = export.read_csv(spark, path, export.for_export(rows).schema) if fmt == "csv" else spark.read.json(path)
            out.append(table.agg(F.lit(fmt).alias("format"), F.count("*").alias("rows"), F.count("parcel_id").alias("filled"), F.lit("").alias("error")))
        except ValueError as e:
            none = F.lit(0).cast("bigint")
            out.append(rows.agg(F.lit(fmt).alias("format"), none.alias("rows"), none.alias("filled"), F.lit(str(e)).alias("error")))
    return reduce(DataFrame.unionByName, out)


@query
def quality_band(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "rec_idx", quality.quality_band(F.col("quality_score")).alias("quality_band")
    )


@query
def long_statistics(spark, sf_dir):
    wide = merge.merge_counts(*_prepared(spark, sf_dir))
    return export.titled(export.long_statistics("merging", wide))


@query
def stage_snapshot(spark, sf_dir):
    root = _run_folder(spark, "stages")
    save_snapshot(_prepared_all(spark, sf_dir), "02_cleaned", new_run_id(), root)
    return load_snapshot(spark, "02_cleaned", root=root).drop("run_id")


# --- the whole job ---


@query
def linked_records(spark, sf_dir):
    # The stages read each side several times: from a written table.
    records, _ = plan.link(*[cut(df, "prepared") for df in _prepared(spark, sf_dir)])
    return _counted(quality.score_records(records.drop(ORDER), timestamp=False))


def _succeeded(result: plan.Result) -> plan.Result:
    if not result.success:
        raise RuntimeError(result.error)
    return result


def _run(spark, sf_dir, **options) -> plan.Result:
    sources = {"left": lambda: _left(spark, sf_dir), "right": lambda: _right(spark, sf_dir)}
    return _succeeded(plan.run(spark, sources, **options))


def _ranked(result: plan.Result) -> DataFrame:
    return _counted(plan.ranked(result).drop(ORDER, "enriched_at"))


@query
def run_resumed(spark, sf_dir):
    """A run that stops at its export, and one that goes on with its stages."""
    sources = {"left": lambda: _left(spark, sf_dir), "right": lambda: _right(spark, sf_dir)}
    stopped = plan.run(spark, sources, snapshots=True, output_path=_run_folder(spark, "x"), output_format="none")
    if stopped.success:
        raise RuntimeError("an unknown format has to stop the run")
    return _ranked(_succeeded(plan.run(spark, sources, snapshots=True, resume=stopped.run_id)))


@query
def run_ranked(spark, sf_dir):
    return _ranked(_run(spark, sf_dir))


@query
def run_landed(spark, sf_dir):
    """Response files and pages to ranked records."""
    stamp = F.lit("2025-01-01T00:00:00")
    result = plan.run_landed(
        spark, _landed_responses(spark, sf_dir), lambda: _property_pages(spark, sf_dir), source_url="https://a.example", extracted_at=stamp
    )
    return _ranked(_succeeded(result))


@query
def run_one_source(spark, sf_dir):
    """Pages alone, as the responses can't be read: the run goes on with what it has."""
    missing = f"{snapshot_root(spark)}/no-such-folder"
    result = _succeeded(plan.run_landed(spark, missing, lambda: _property_pages(spark, sf_dir), extracted_at=F.lit("2025-01-01T00:00:00")))
    failed = F.lit(", ".join(sorted(result.source_errors)))
    return result.records.agg(failed.alias("failed_source"), F.count("*").alias("records"), F.max("quality_score").alias("best_score"))


@query
def run_statistics(spark, sf_dir):
    """All sections; the seconds of the run only as whether there were any."""
    stats = _run(spark, sf_dir, output_path=_run_folder(spark, "exported"), output_format="json").statistics
    value = F.col("value").cast("double")
    return stats.withColumn("value", F.when(F.col("section") == "run", (value > 0).cast("double")).otherwise(value))


@query
def run_duplicates(spark, sf_dir):
    return _counted(_run(spark, sf_dir).duplicates())


# --- documented extras ---


@query
def address_units(spark, sf_dir):
    shown = F.concat("property_address", F.lit(" Apt. "), (F.col("rec_idx") % 9).cast("string"))
    shown = F.when(F.col("rec_idx") % 2 == 0, shown).otherwise(F.concat("property_address", F.lit(", # 4B")))
    shown = F.when(F.col("rec_idx") % 3 == 0, F.col("property_address")).otherwise(shown)
    got = documented.with_unit(_all(spark, sf_dir).withColumn("property_address", shown))
    return got.select("rec_idx", "property_address", "unit_number")


@query
def address_variants(spark, sf_dir):
    shown = F.regexp_replace("property_address", "(North|Street)", "N.E. $1 STR")
    return _all(spark, sf_dir).select("rec_idx", documented.normalize_address_fully(shown).alias("property_address"))


@query
def owner_strict(spark, sf_dir):
    shown = F.concat("owner_name", F.when(F.col("rec_idx") % 2 == 0, " & Sons, Inc.").otherwise(" L.L.C."))
    return _all(spark, sf_dir).select("rec_idx", documented.normalize_owner_strictly(shown).alias("owner_name"))


@query
def parcel_ids(spark, sf_dir):
    return _all(spark, sf_dir).select("rec_idx", documented.normalize_parcel(F.col("parcel_id"), 10).alias("parcel_id"))


@query
def keep_originals(spark, sf_dir):
    wanted = {f: clean.KINDS[f] for f in ("owner_name", "property_address")}
    got = documented.keep_originals(_all(spark, sf_dir), wanted)
    return got.select("rec_idx", "owner_name", "owner_name_normalized", "property_address", "property_address_normalized")


@query
def exact_address_groups(spark, sf_dir):
    return documented.exact_address_groups(_all(spark, sf_dir)).select("rec_idx", "duplicate_group")


@query
def best_of_group(spark, sf_dir):
    tagged = documented.mark_best(_exact(spark, sf_dir), F.lit("exact_parcel_match"))
    return tagged.select("rec_idx", "is_duplicate", "duplicate_of", "dedup_reason")


def _joined(spark, sf_dir) -> DataFrame:
    return documented.joined_sources(*_prepared(spark, sf_dir))


@query
def base_merge(spark, sf_dir):
    got = documented.merge_with_base(_joined(spark, sf_dir)).withColumnRenamed("_key", "merge_key")
    return got.withColumn("field_sources", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("field_sources")))))


@query
def field_origins(spark, sf_dir):
    return documented.field_source_counts(documented.merge_with_base(_joined(spark, sf_dir)))


@query
def merge_conflicts(spark, sf_dir):
    got = documented.conflicts(_joined(spark, sf_dir))
    return got.select("l_rec_idx", "r_rec_idx", "owner_score", "owner_conflict", "address_conflict")


@query
def enrichment_statistics(spark, sf_dir):
    return documented.enrichment_statistics(documented.merge_with_base(_joined(spark, sf_dir)))


@query
def summary_metrics(spark, sf_dir):
    merged = documented.merge_with_base(_joined(spark, sf_dir))
    return documented.summary_metrics(quality.score_records(merged, timestamp=False))


@query
def record_urls(spark, sf_dir):
    return _all(spark, sf_dir).select("rec_idx", documented.record_url(F.col("parcel_id")).alias("record_url"))


@query
def bonus_score(spark, sf_dir):
    rows = _prepared_all(spark, sf_dir)
    merged, clean_row = F.col("county") == "Orange", F.col("zip_code").rlike(r"^\d{5}$")
    score = documented.bonus_score(rows, merged, clean_row)
    return rows.select(
        "rec_idx", score.alias("bonus_score"), documented.enrichment_level(score).alias("enrichment_level")
    )


@query
def owner_types(spark, sf_dir):
    return _prepared_all(spark, sf_dir).select("rec_idx", documented.owner_type(F.col("owner_name")).alias("owner_type"))


@query
def record_notes(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    text_ = documented.notes(rows, F.col("county") == "Orange", F.lit(False), F.lit(False), F.col("quality_score") - 20)
    return rows.select("rec_idx", text_.alias("notes"))


@query
def quality_issues(spark, sf_dir):
    rows = quality.score_records(_all(spark, sf_dir), timestamp=False)
    return documented.quality_issues(rows)


@query
def record_flags(spark, sf_dir):
    shown = F.when(F.col("rec_idx") % 5 == 0, F.concat(F.lit("P.O. Box "), F.col("rec_idx").cast("string"))).otherwise(
        F.col("property_address")
    )
    return _all(spark, sf_dir).select(
        "rec_idx",
        documented.is_po_box(shown).alias("is_po_box"),
        documented.is_suspicious_name(F.col("owner_name")).alias("is_suspicious_name"),
        documented.is_not_available(F.col("zip_code")).alias("zip_not_available"),
    )


@query
def range_errors(spark, sf_dir):
    rows = _all(spark, sf_dir).withColumn("year_built", (F.col("rec_idx") % 600 + 1500).cast("int"))
    got = documented.range_errors(rows, F.lit("2024-02-01").cast("date"))
    return rows.select("rec_idx", F.array_join(got, " | ").alias("range_errors"))
