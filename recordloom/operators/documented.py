"""Operators that are specified in words only; all are off by default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.config import CANONICAL_FIELDS, NUMERIC_FIELDS, REQUIRED_FIELDS
from recordloom.functions.similarity import normal_form, similarity
from recordloom.functions.text import collapse, is_blank, match_key, normalize_address
from recordloom.operators.clean import apply_steps
from recordloom.operators.dedup import GROUP
from recordloom.operators.joins import join_where_keyed
from recordloom.operators.merge import KEY, join_sources
from recordloom.operators.quality import has_value

# --- Fixed values: word lists, weights and limits. ---
UNIT_PATTERN = r"(?i)(?:\b(?:APT|APARTMENT|UNIT|STE|SUITE)\b\.?\s*#?\s*|#\s*)([A-Z0-9-]+)"
STREET_VARIANTS = {
    "STREET": "ST", "STR": "ST", "ST.": "ST",
    "AVENUE": "AVE", "AVE.": "AVE",
    "ROAD": "RD", "RD.": "RD",
    "DRIVE": "DR", "DR.": "DR",
    "BOULEVARD": "BLVD", "BLVD.": "BLVD",
    "LANE": "LN", "LN.": "LN",
    "COURT": "CT", "CT.": "CT",
    "CIRCLE": "CIR", "CIR.": "CIR",
    "NORTHEAST": "NE", "NE.": "NE", "N.E.": "NE",
    "NORTHWEST": "NW", "NW.": "NW", "N.W.": "NW",
    "SOUTHEAST": "SE", "SE.": "SE", "S.E.": "SE",
    "SOUTHWEST": "SW", "SW.": "SW", "S.W.": "SW",
    "NORTH": "N", "N.": "N",
    "SOUTH": "S", "S.": "S",
    "EAST": "E", "E.": "E",
    "WEST": "W", "W.": "W",
}
ENTITY_FORMS = {
    r"\bL\.\s?L\.\s?C\.?|\bL L C\b": "LLC",
    r"\b(CORPORATION|INCORPORATED|INC|CORP)\b\.?": "CORP",
    r"\b(FAMILY|LIVING) TRUST\b": "TRUST",
}
DROPPED_CHARACTERS = r"""[!@#$%^*()+={}\[\]|\\:;"'<>?,./`]"""
ENTITY_WORDS = ["LLC", "CORP", "INC", "TRUST", "LP", "LLP", "PARTNERSHIP"]
PO_BOX = r"(?i)\bP\.?\s*O\.?\s*BOX\b"
BONUS_WEIGHTS = {
    "owner_name": 15, "property_address": 15, "parcel_id": 10, "city": 5, "state": 2, "zip_code": 3,
    "assessed_value": 8, "sale_price": 7, "sale_date": 5, "square_footage": 6, "year_built": 6,
    "bedrooms": 4, "bathrooms": 4, "deed_book": 3, "deed_page": 2,
}
MERGED_BONUS, CLEAN_BONUS = 10, 5
ENHANCED_FROM, COMPLETE_FROM, LOW_BELOW = 70, 90, 60
OWNER_CONFLICT_BELOW = 90
DETAIL_FIELDS = [
    "square_footage", "year_built", "bedrooms", "bathrooms", "sale_price", "sale_date", "deed_book", "deed_page",
]
URL_TEMPLATE = "https://data.wake.gov/property/{parcel_id}"
FIRST_YEAR_BUILT = 1600
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK "
    "OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
# --- End of fixed values. ---


def with_unit(df: DataFrame, address: str = "property_address") -> DataFrame:
    """Move the unit of an address to ``unit_number``."""
    c = F.col(address)
    unit = F.upper(F.regexp_extract(c, UNIT_PATTERN, 1))
    rest = collapse(F.regexp_replace(F.regexp_replace(c, UNIT_PATTERN, " "), r"[\s,]+$", ""))
    return df.withColumns({"unit_number": unit, address: F.when(unit != "", rest).otherwise(c)})


def normalize_address_fully(c: Column) -> Column:
    """Upper case with all street and direction variants shortened, per word."""
    short = F.create_map(*[F.lit(x) for kv in STREET_VARIANTS.items() for x in kv])
    words = F.split(F.upper(collapse(c)), " ")
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.coalesce(short[w], w)), " "), F.lit(""))


def normalize_owner_strictly(c: Column) -> Column:
    """Upper case, entity words in one form, special characters dropped."""
    out = F.upper(collapse(c))
    for pattern, short in ENTITY_FORMS.items():
        out = F.regexp_replace(out, pattern, short)
    return F.coalesce(collapse(F.regexp_replace(out, DROPPED_CHARACTERS, "")), F.lit(""))


def normalize_parcel(c: Column, width: int = 0) -> Column:
    """Upper case without dashes and blanks, zero-padded to ``width``."""
    out = F.regexp_replace(F.upper(c), r"[-\s]", "")
    return F.when(F.length(out) < width, F.lpad(out, width, "0")).otherwise(out) if width else out


def keep_originals(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Normalised values in new columns; the originals stay."""
    copies = df.withColumns({f"{f}_normalized": F.col(f) for f in kinds})
    return apply_steps(copies, {f"{f}_normalized": k for f, k in kinds.items()})


def exact_address_groups(df: DataFrame, order: str = "rec_idx") -> DataFrame:
    """Add ``duplicate_group`` for rows that share normalised address, city and
    ZIP; rows without an address are unique."""
    address = normalize_address(F.col("property_address"))
    key = F.concat_ws("|", address, match_key(F.coalesce("city", F.lit(""))), F.coalesce("zip_code", F.lit("")))
    marked = df.withColumn("_key", F.when(address != "", key))
    groups = marked.filter("_key is not null").groupBy("_key").agg(F.min(order).alias(GROUP), F.count("*").alias("_n"))
    return join_where_keyed(marked, groups.filter("_n > 1").drop("_n"), ["_key"], order).drop("_key")


def mark_best(tagged: DataFrame, reason: Column, order: str = "rec_idx") -> DataFrame:
    """Keep the best row of each group (fewest empty fields, then newest, then
    merged, then first) and mark the others.

    The best row is an aggregate with a partial step, joined back by group.
    """
    empty = reduce(
        lambda a, b: a + b, [F.when(has_value(tagged, f), 0).otherwise(1) for f in CANONICAL_FIELDS], F.lit(0)
    )
    merged = (
        F.coalesce(F.col("is_cross_source_merged"), F.lit(False))
        if "is_cross_source_merged" in tagged.columns
        else F.lit(False)
    )
    newest = F.coalesce(F.col("extracted_at"), F.lit(""))
    quality = F.struct(-empty, newest, merged.cast("int"))
    ranked = tagged.withColumn("_quality", quality)
    best = (
        ranked.filter(F.col(GROUP).isNotNull())
        .groupBy(GROUP)
        .agg(F.max("_quality").alias("_best"))
    )
    firsts = (
        ranked.join(best, GROUP)
        .filter(F.col("_quality") == F.col("_best"))
        .groupBy(GROUP)
        .agg(F.min(F.struct(F.col(order).alias("o"), F.col("parcel_id").alias("p"))).alias("_kept"))
    )
    out = join_where_keyed(ranked.drop("_quality"), firsts, [GROUP], order)
    dup = F.coalesce(F.col(order) != F.col("_kept.o"), F.lit(False))
    return out.withColumns(
        {
            "is_duplicate": dup,
            "duplicate_of": F.when(dup, F.col("_kept.p")),
            "dedup_reason": F.when(dup, reason),
        }
    ).drop("_kept")


def joined_sources(
    left: DataFrame, right: DataFrame, key: str = "parcel_id", order: str = "rec_idx"
) -> DataFrame:
    """Full outer join as ``l_*`` and ``r_*`` columns with a ``data_source`` tag."""
    tag = (
        F.when(F.col("r_here").isNull(), "api_only").when(F.col("l_here").isNull(), "scraped_only").otherwise("merged")
    )
    joined = join_sources(left, right, key, order).withColumn("data_source", tag)
    return joined.drop("l_here", "r_here").withColumnsRenamed({f"{s}_order": f"{s}_{order}" for s in "lr"})


def merge_with_base(joined: DataFrame, fields: list[str] = CANONICAL_FIELDS) -> DataFrame:
    """Left values win, but detail fields prefer the right side; ``field_sources``
    says per field which side the value came from."""
    types = {f.name: f.dataType.typeName() for f in joined.schema.fields}

    def filled(c: str) -> Column:
        return F.when(~is_blank(F.col(c)), F.col(c)) if types[c] == "string" else F.col(c)

    values, origins = [], []
    for f in fields:
        sides = ["r", "l"] if f in DETAIL_FIELDS else ["l", "r"]
        values.append(F.coalesce(*[filled(f"{s}_{f}") for s in sides]).alias(f))
        origin = F.coalesce(
            *[F.when(filled(f"{s}_{f}").isNotNull(), F.lit({"l": "api", "r": "scraped"}[s])) for s in sides]
        )
        origins.append(F.struct(F.lit(f).alias("key"), origin.alias("value")))
    provenance = F.map_from_entries(F.filter(F.array(*origins), lambda o: o["value"].isNotNull()))
    return joined.select(KEY, "data_source", *values, provenance.alias("field_sources"))


def conflicts(joined: DataFrame) -> DataFrame:
    """Merged pairs whose owner similarity is below 90 or whose normalised
    addresses differ."""
    both = joined.filter("data_source = 'merged'")
    score = similarity(normal_form(F.col("l_owner_name")), normal_form(F.col("r_owner_name")))
    scored = both.withColumn("owner_score", score)
    la, ra = [normalize_address(F.col(f"{s}_property_address")) for s in "lr"]
    return scored.withColumns(
        {
            "owner_conflict": F.col("owner_score") < OWNER_CONFLICT_BELOW,
            "address_conflict": (la != "") & (ra != "") & (la != ra),
        }
    ).filter("owner_conflict or address_conflict")


def enrichment_statistics(merged: DataFrame) -> DataFrame:
    """Share of merged rows and number of field values that the right side gave."""
    scraped = F.size(F.filter(F.map_values("field_sources"), lambda v: v == "scraped"))
    is_merged = F.col("data_source") == "merged"
    return merged.agg(
        F.count("*").alias("total_records"),
        F.count_if(is_merged).alias("merged_records"),
        F.coalesce(F.sum(F.when(is_merged, scraped)), F.lit(0)).alias("fields_added"),
    ).withColumn("enrichment_rate", F.bround(F.try_divide("merged_records", "total_records") * 100.0, 2))


def summary_metrics(scored: DataFrame) -> DataFrame:
    """(metric, value): rows, share of merged rows, average score overall and per
    ``data_source``, and how often each field is filled, from one aggregation
    per data source."""
    sums = {f: F.sum(F.when(has_value(scored, f), 1).otherwise(0)) for f in CANONICAL_FIELDS}
    each = scored.groupBy("data_source").agg(
        F.count("*").alias("n"), F.sum("quality_score").alias("s"), *[c.alias(f) for f, c in sums.items()]
    )
    rows = F.sum("n")

    def percent(part: Column) -> Column:
        return F.bround(F.try_divide(part, rows) * 100.0, 2)

    total = each.agg(
        rows.cast("double").alias("records"),
        percent(F.sum(F.when(F.col("data_source") == "merged", F.col("n")).otherwise(0))).alias("enrichment_rate"),
        F.bround(F.try_divide(F.sum("s"), rows), 2).alias("avg_score"),
        *[percent(F.sum(f)).alias(f"filled_percent_{f}") for f in CANONICAL_FIELDS],
    )
    by_source = each.select(
        F.concat(F.lit("avg_score_"), "data_source").alias("metric"), F.bround(F.col("s") / F.col("n"), 2).alias("value")
    )
    return total.unpivot([], total.columns, "metric", "value").unionByName(by_source)


def record_url(parcel: Column, template: str = URL_TEMPLATE) -> Column:
    before, after = template.split("{parcel_id}")
    return F.when(~is_blank(parcel), F.concat(F.lit(before), parcel, F.lit(after)))


def bonus_score(df: DataFrame, merged: Column, clean: Column) -> Column:
    """Weighted score with a bonus for merged and for clean rows, at most 100."""
    total = F.lit(0)
    for f, w in BONUS_WEIGHTS.items():
        total = total + F.when(has_value(df, f), F.lit(w)).otherwise(F.lit(0))
    total = total + F.when(merged, MERGED_BONUS).otherwise(0) + F.when(clean, CLEAN_BONUS).otherwise(0)
    return F.least(total, F.lit(100))


def owner_type(name: Column) -> Column:
    entity = F.upper(name).rlike(rf"\b({'|'.join(ENTITY_WORDS)})\b")
    return F.when(entity, "entity").otherwise("individual")


def enrichment_level(score: Column) -> Column:
    return F.when(score >= COMPLETE_FROM, "complete").when(score >= ENHANCED_FROM, "enhanced").otherwise("basic")


def notes(df: DataFrame, merged: Column, close_match: Column, owner_conflict: Column, score: Column) -> Column:
    missing_sale = ~(has_value(df, "sale_price") & has_value(df, "sale_date"))
    return F.concat_ws(
        "; ",
        F.when(merged, "Enriched with scraped data"),
        F.when(missing_sale, "Missing sale data"),
        F.when(close_match, "Possible duplicate - manually review"),
        F.when(owner_conflict, "Conflict detected: owner names differ"),
        F.when(score < LOW_BELOW, "Low quality score - missing fields"),
    )


def quality_issues(df: DataFrame, required: list[str] = REQUIRED_FIELDS, order: str = "rec_idx") -> DataFrame:
    """One row per issue: missing required fields are critical, low scores and
    PO boxes are warnings; critical ones first, then the lowest scores."""

    def issue(kind: str, text: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(text).alias("description")))

    found = [issue("CRITICAL", f"Missing required field: {f}", ~has_value(df, f) | is_not_available(F.col(f))) for f in required]
    found.append(issue("WARNING", "Low quality score", F.col("quality_score") < LOW_BELOW))
    found.append(issue("WARNING", "PO Box address", is_po_box(F.col("property_address"))))
    each = df.select(order, "parcel_id", "quality_score", F.explode(F.array_compact(F.array(*found))).alias("_i"))
    return each.select(order, "parcel_id", "_i.issue_type", "_i.description", "quality_score").orderBy(
        "issue_type", "quality_score", order, "description"
    )


def is_po_box(address: Column) -> Column:
    return F.coalesce(address.rlike(PO_BOX), F.lit(False))


def is_suspicious_name(name: Column) -> Column:
    """All capitals, or digits only."""
    all_caps = (name == F.upper(name)) & name.rlike(r"\p{Lu}")
    return F.coalesce(all_caps | name.rlike(r"^[\d\s]+$"), F.lit(False))


def is_not_available(c: Column) -> Column:
    return F.coalesce(match_key(c) == "N/A", F.lit(False))


def range_errors(df: DataFrame, today: Column | None = None) -> Column:
    """Values out of range: future sale date, negative amounts, unknown state,
    year built before 1600 or after this year."""
    now = today if today is not None else F.current_date()
    out = [
        F.when(F.try_to_timestamp("sale_date", F.lit("yyyy-MM-dd")).cast("date") > now, "sale_date is in the future"),
        *[F.when(F.col(f) < 0, f"{f} is negative") for f in NUMERIC_FIELDS if f in df.columns],
        F.when(~is_blank(F.col("state")) & ~F.col("state").isin(STATES), "state is unknown"),
    ]
    if "year_built" in df.columns:
        year = F.col("year_built")
        out.append(F.when((year < FIRST_YEAR_BUILT) | (year > F.year(now)), "year_built is out of range"))
    return F.array_compact(F.array(*out))


def field_source_counts(merged: DataFrame) -> DataFrame:
    """Rows per field and side that gave the value."""
    each = merged.select(F.explode("field_sources").alias("field", "origin"))
    return each.groupBy("field", "origin").agg(F.count("*").alias("n"))
