"""The registered queries as plain SQL (DuckDB), written independently."""

from __future__ import annotations

import re

from recordloom.config import (
    CANONICAL_FIELDS,
    COMPANY_MARKERS,
    ENTITY_SUFFIXES,
    FIELD_PATTERNS,
    NUMERIC_FIELDS,
    QUALITY_WEIGHTS,
    REQUIRED_FIELDS,
    STATE_CODES,
    STREET_ABBREVIATIONS,
)
from recordloom.operators import documented as doc
from recordloom.plans.queries import raw_json
from recordloom.sources import adapter

TEXT_FIELDS = [f for f in CANONICAL_FIELDS if f not in NUMERIC_FIELDS]
FIELDS = ", ".join(CANONICAL_FIELDS)
LEFT, RIGHT, ALL = adapter.LEFT_SQL, adapter.right_sql(), adapter.all_sql()


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def title(c: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({c}, '([A-Za-z]+|[^A-Za-z]+)', 1), "
        "lambda r: upper(r[1]) || lower(r[2:])), '')"
    )


def is_blank(c: str) -> str:
    return f"coalesce({strip(c)} = '', true)"


def name_steps(rel: str) -> str:
    """``rel`` with its owner name cleaned, one step per subquery."""
    any_company = " OR ".join(f"contains(upper(owner_name), '{m}')" for m in COMPANY_MARKERS)
    whens = []
    for s in reversed(ENTITY_SUFFIXES):
        for form in (s, re.escape("".join(ch + "." for ch in s)), " ".join(s)):
            whens.append(rf"WHEN regexp_matches(_up, '\b{form}\b') THEN regexp_replace(_up, '\b{form}\b', '{s}', 'g')")
    suffixes = ", ".join(f"'{s}'" for s in ENTITY_SUFFIXES)
    word = (
        f"CASE WHEN upper(w) IN ({suffixes}) THEN upper(w) "
        f"WHEN length(w) <= 3 AND w = upper(w) AND regexp_matches(w, '[A-Z]') THEN w ELSE {title('w')} END"
    )
    return f"""
SELECT * EXCLUDE (_up) REPLACE (coalesce(trim(array_to_string(
  list_transform(string_split({collapse('owner_name')}, ' '), lambda w: {word}), ' ')), '') AS owner_name) FROM (
SELECT * REPLACE (CASE {' '.join(whens)} ELSE owner_name END AS owner_name) FROM (
SELECT *, upper(owner_name) AS _up FROM (
SELECT * REPLACE (CASE WHEN contains(owner_name, ',') AND NOT ({any_company})
  THEN trim(substr(owner_name, strpos(owner_name, ',') + 1)) || ' ' || trim(split_part(owner_name, ',', 1))
  ELSE owner_name END AS owner_name) FROM (
SELECT * REPLACE ({collapse('owner_name')} AS owner_name) FROM ({rel})))))"""


def address(c: str) -> str:
    out = f"upper({collapse(c)})"
    for w, s in STREET_ABBREVIATIONS.items():
        out = rf"regexp_replace({out}, '\b{w}\b', '{s}', 'g')"
    return f"coalesce({out}, '')"


def state(c: str) -> str:
    up = f"upper({strip(c)})"
    whens = " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in STATE_CODES.items())
    return f"coalesce(substr(CASE {up} {whens} ELSE {up} END, 1, 2), '')"


def zip_code(c: str) -> str:
    d = f"trim(regexp_replace({c}, '[^0-9-]', '', 'g'), '-')"
    fill = lambda x: f"CASE WHEN length({x}) < 5 THEN lpad({x}, 5, '0') ELSE {x} END"
    parts = f"string_split({d}, '-')"
    return f"""CASE WHEN coalesce({c}, '') = '' THEN ''
      WHEN len({parts}) = 2 THEN {fill(f"{parts}[1]")} || '-' || rpad({parts}[2][:4], 4, '0')
      WHEN len({parts}) > 2 THEN NULL
      WHEN length({d}) = 9 THEN {d}[:5] || '-' || {d}[6:]
      WHEN length({d}) <= 5 THEN {fill(d)} ELSE {d}[:5] END"""


def cleaned(rel: str) -> str:
    return f"""
SELECT * REPLACE ({address('property_address')} AS property_address, {address('mailing_address')} AS mailing_address,
  {title(collapse('city'))} AS city, {state('state')} AS state, {zip_code('zip_code')} AS zip_code)
FROM ({name_steps(rel)})"""


def required_ok() -> str:
    return " AND ".join(f"NOT {is_blank(f)}" for f in REQUIRED_FIELDS)


def prepared(rel: str) -> str:
    return cleaned(f"SELECT * FROM ({rel}) WHERE {required_ok()}")


def has_value(f: str) -> str:
    return f"coalesce({f} <> 0, false)" if f in NUMERIC_FIELDS else f"NOT {is_blank(f)}"


def score(weights: dict = QUALITY_WEIGHTS) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {has_value(f)} THEN {w} ELSE 0 END" for f, w in weights.items()) + " AS DOUBLE)"


def scored(rel: str) -> str:
    filled = " + ".join(f"CASE WHEN {has_value(f)} THEN 1 ELSE 0 END" for f in QUALITY_WEIGHTS)
    return f"""
SELECT *, CASE WHEN quality_score >= 80 THEN 'High' WHEN quality_score >= 50 THEN 'Medium' ELSE 'Low' END AS quality_level
FROM (SELECT *, {score()} AS quality_score,
  CAST(round_even(({filled})::DOUBLE / {len(QUALITY_WEIGHTS)}::DOUBLE * 100::DOUBLE, 2) AS DOUBLE) AS completeness_percent
  FROM ({rel}))"""


def errors(strict: bool) -> str:
    req = ", ".join(
        f"CASE WHEN {is_blank(f)} THEN 'Required field is empty: {f}' END" for f in REQUIRED_FIELDS
    )
    pat = ", ".join(
        f"CASE WHEN NOT {is_blank(f)} AND NOT regexp_matches({strip(f)}, '{p}') "
        f"THEN 'Field ''{f}'' does not match required pattern: ' || {strip(f)} END"
        for f, p in FIELD_PATTERNS.items()
    )
    not_null = lambda xs: f"list_filter([{xs}], lambda e: e IS NOT NULL)"
    decisive = "_errors" if strict else "_req"
    return f"""
SELECT * EXCLUDE (_req, _errors), len({decisive}) = 0 AS is_valid, _errors AS error_list FROM (
SELECT *, CASE WHEN len(_req) > 0 THEN _req ELSE {not_null(pat)} END AS _errors FROM (
SELECT *, {not_null(req)} AS _req FROM ({{rel}})))"""


def checked(rel: str, strict: bool = False) -> str:
    return errors(strict).replace("{rel}", rel)


def keyed(rel: str) -> str:
    return f"SELECT *, upper({strip('parcel_id')}) AS _key FROM ({rel}) WHERE parcel_id <> ''"


def survivor(f: str, prefer: str | None = None) -> str:
    a, b = f"l.{f}", f"r.{f}"
    if f == "source":
        return f"concat_ws(' + ', nullif({a}, ''), nullif({b}, ''))"
    if f == "source_url":
        return f"concat_ws(' | ', nullif({a}, ''), nullif({b}, ''))"
    if f == "extracted_at":
        return f"coalesce(greatest(nullif({a}, ''), nullif({b}, '')), '')"
    if f in NUMERIC_FIELDS:
        return f"coalesce({a}, {b})"
    first = f"WHEN l.source = '{prefer}' THEN {a} WHEN r.source = '{prefer}' THEN {b}" if prefer else ""
    return (
        f"CASE WHEN {is_blank(a)} AND {is_blank(b)} THEN '' WHEN {is_blank(a)} THEN {b} WHEN {is_blank(b)} THEN {a} "
        f"{first} WHEN length({a}) >= length({b}) THEN {a} ELSE {b} END"
    )


def merged(left: str, right: str, prefer: str | None = None) -> str:
    cols = ", ".join(f"{survivor(f, prefer)} AS {f}" for f in CANONICAL_FIELDS)
    one = lambda s: ", ".join(f"{s}.{f}" for f in CANONICAL_FIELDS)
    return f"""
WITH l AS ({keyed(left)}), r AS ({keyed(right)})
SELECT l._key AS merge_key, l.rec_idx AS left_order, r.rec_idx AS right_order, {cols}, true AS is_cross_source_merged
FROM l JOIN r ON l._key = r._key
UNION ALL SELECT l._key, l.rec_idx, NULL, {one('l')}, NULL FROM l WHERE l._key NOT IN (SELECT _key FROM r)
UNION ALL SELECT r._key, NULL, r.rec_idx, {one('r')}, NULL FROM r WHERE r._key NOT IN (SELECT _key FROM l)"""


PREP_LEFT, PREP_RIGHT, PREP_ALL = prepared(LEFT), prepared(RIGHT), prepared(ALL)
MERGED = merged(PREP_LEFT, PREP_RIGHT)
SCORED = scored(PREP_ALL)


def exact(rel: str, order: str = "rec_idx") -> str:
    """``rel`` with the first row of its exact group as ``duplicate_group``."""
    return f"""
SELECT * EXCLUDE (_k, _n, _first), CASE WHEN _n > 1 THEN _first END AS duplicate_group FROM (
SELECT *, CASE WHEN _k IS NOT NULL THEN count(*) OVER (PARTITION BY _k) END AS _n,
  min({order}) OVER (PARTITION BY _k) AS _first
FROM (SELECT *, CASE WHEN parcel_id <> '' THEN nullif(upper({strip('parcel_id')}), '') END AS _k FROM ({rel})))"""


def token_sort(c: str) -> str:
    words = rf"string_split(trim(lower(regexp_replace(regexp_replace({c}, '[^\x00-\x7f]', '', 'g'), '\W', ' ', 'g'))), ' ')"
    return f"array_to_string(list_sort(list_filter({words}, lambda w: w <> '')), ' ')"


def lcs(a: str, b: str) -> str:
    bit = f"CASE WHEN {a}[i] = ch THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END"
    mask = f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: {bit})), 0)::HUGEINT"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    row = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda ch: {mask})), "
    row += f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"(length({a}) - bit_count({row}))"


def ratio(a: str, b: str) -> str:
    raw = f"100::DOUBLE * ((2::DOUBLE * {lcs(a, b)}) / (length({a}) + length({b})))"
    return (
        f"CASE WHEN {a} = {b} THEN 100 WHEN {a} = '' OR {b} = '' THEN 0 ELSE CAST(round_even({raw}, 0) AS INT) END"
    )


def near(a: str, b: str, threshold: int) -> str:
    """A cheap test that loses no pair: an edit distance is never above the
    number of insertions and deletions."""
    most = f"floor({(100.5 - threshold) / 100} * (length({a}) + length({b})) + 0.001)"
    return f"abs(length({a}) - length({b})) <= {most} AND levenshtein({a}, {b}) <= {most}"


def fuzzy_ctes(rel: str, order: str = "rec_idx") -> str:
    """CTEs up to ``fuzzy_edges`` (lo, hi) over distinct names and addresses."""
    raw = lambda f: f"upper({strip(f'coalesce({f}, chr(32))')})"
    return f"""
fuzzy_rows AS MATERIALIZED (
  SELECT {order} AS ord, {token_sort(raw('owner_name'))} AS n,
    CASE WHEN {raw('property_address')} <> '' THEN {token_sort(raw('property_address'))} END AS a
  FROM ({rel}) WHERE {raw('owner_name')} <> ''),
vertices AS MATERIALIZED (SELECT n, a, min(ord) AS v, count(*) AS size FROM fuzzy_rows GROUP BY n, a),
close_pairs AS MATERIALIZED (
  SELECT x.v AS lo, y.v AS hi, x.n AS n1, y.n AS n2, x.a AS a1, y.a AS a2
  FROM vertices x JOIN vertices y ON x.v < y.v
  WHERE {near('x.n', 'y.n', 90)} AND (x.a IS NULL OR y.a IS NULL OR ({near('x.a', 'y.a', 95)}))),
fuzzy_edges AS MATERIALIZED (
  SELECT lo, hi FROM close_pairs
  WHERE {ratio('n1', 'n2')} >= 90 AND (a1 IS NULL OR a2 IS NULL OR {ratio('a1', 'a2')} >= 95))"""


def fuzzy_group_ctes(rel: str, order: str = "rec_idx") -> str:
    """CTEs up to ``fuzzy_groups`` (ord, duplicate_group). Edges are taken in
    order; one counts only while neither end has been absorbed."""
    gone = lambda x: f"list_contains(list_transform(acc, lambda p: p.hi), e[1].{x})"
    return f"""{fuzzy_ctes(rel, order)},
folded AS MATERIALIZED (
  SELECT list_reduce(list_prepend([]::STRUCT(lo BIGINT, hi BIGINT)[], list([{{'lo': lo, 'hi': hi}}] ORDER BY lo, hi)),
    lambda acc, e: CASE WHEN {gone('lo')} OR {gone('hi')} THEN acc ELSE list_concat(acc, e) END) AS kept
  FROM (SELECT lo::BIGINT AS lo, hi::BIGINT AS hi FROM fuzzy_edges)),
taken AS MATERIALIZED (SELECT p.lo AS seed, p.hi AS v FROM (SELECT unnest(kept) AS p FROM folded)),
labels AS (
  SELECT x.n, x.a, coalesce(t.seed, x.v) AS duplicate_group FROM vertices x LEFT JOIN taken t ON x.v = t.v
  WHERE t.seed IS NOT NULL OR x.size > 1 OR x.v IN (SELECT seed FROM taken)),
fuzzy_groups AS (
  SELECT ord, duplicate_group FROM fuzzy_rows f JOIN labels g ON f.n = g.n AND f.a IS NOT DISTINCT FROM g.a)"""


def folded_rows(rel: str, order: str = "rec_idx", fields=CANONICAL_FIELDS, flags: str = "") -> str:
    """One most complete row per duplicate_group of ``rel``."""
    cols = []
    for f in fields:
        if f in NUMERIC_FIELDS:
            cols.append(f"first({f} ORDER BY {order}) FILTER (WHERE {f} IS NOT NULL) AS {f}")
        else:
            cols.append(f"coalesce(first({f} ORDER BY length({f}) DESC, {order}) FILTER (WHERE {f} <> ''), '') AS {f}")
    keep = f"min({order}) AS {order}, "
    return f"""
SELECT {keep}{', '.join(cols)}{flags}, true AS is_merged, count(*) AS duplicate_count
FROM ({rel}) WHERE duplicate_group IS NOT NULL GROUP BY duplicate_group"""


def stats(groups: str) -> str:
    return f"""
SELECT count(*) AS total_groups, coalesce(sum(n), 0)::BIGINT AS total_duplicates,
  coalesce(avg(n), 0)::DOUBLE AS avg_group_size, coalesce(max(n), 0) AS max_group_size, min(n) AS min_group_size
FROM (SELECT count(*) AS n FROM ({groups}) WHERE duplicate_group IS NOT NULL GROUP BY duplicate_group)"""


def both_phases(rel: str) -> str:
    """WITH clause: ``tagged`` is ``rel`` with group and kind of both phases."""
    return f"""
WITH base AS MATERIALIZED ({exact(rel).replace('duplicate_group', 'exact_group')}),
{fuzzy_group_ctes('SELECT * FROM base WHERE exact_group IS NULL')},
tagged AS (
  SELECT b.* EXCLUDE (exact_group), coalesce(exact_group, g.duplicate_group) AS duplicate_group,
    CASE WHEN exact_group IS NOT NULL THEN 'exact' WHEN g.duplicate_group IS NOT NULL THEN 'fuzzy' END AS duplicate_kind
  FROM base b LEFT JOIN fuzzy_groups g ON b.rec_idx = g.ord)"""


TAGGED = both_phases(PREP_ALL)
UNIQUE_PLUS = f"""
SELECT rec_idx, {FIELDS}, NULL::BOOLEAN AS is_merged, NULL::BIGINT AS duplicate_count FROM {{rel}} WHERE duplicate_group IS NULL
UNION ALL SELECT rec_idx, {FIELDS}, is_merged, duplicate_count FROM ({folded_rows('SELECT * FROM {rel}')})"""

# The whole job: merged rows in order, exact groups, fuzzy groups among the rest.
_FLAG = ", bool_or(is_cross_source_merged) AS is_cross_source_merged"


def job(merged_rows: str) -> str:
    """WITH clause up to ``tagged``."""
    return both_phases(f"""
SELECT row_number() OVER (ORDER BY merge_key, left_order NULLS FIRST, right_order NULLS FIRST) AS rec_idx, *
  EXCLUDE (merge_key, left_order, right_order) FROM ({merged_rows})""")


JOB = job(MERGED)
JOB_IN_ORDER = f"""
SELECT rec_idx, {FIELDS}, is_cross_source_merged, NULL::BOOLEAN AS is_merged, NULL::BIGINT AS duplicate_count
FROM tagged WHERE duplicate_group IS NULL
UNION ALL SELECT rec_idx, {FIELDS}, is_cross_source_merged, is_merged, duplicate_count
FROM ({folded_rows('SELECT * FROM tagged', flags=_FLAG)})"""
JOB_RECORDS = f"SELECT * EXCLUDE (rec_idx) FROM ({JOB_IN_ORDER})"


def ranked_job(merged_rows: str) -> str:
    """Records of the whole job with their rank; ties in merged order."""
    return f"""{job(merged_rows)}, records AS ({JOB_IN_ORDER})
SELECT * EXCLUDE (rec_idx), row_number() OVER (ORDER BY quality_score DESC, rec_idx) AS quality_rank
FROM ({scored('SELECT * FROM records')})"""


COUNTS = """
SELECT (SELECT count(*) FROM m WHERE right_order IS NULL) AS left_only,
  (SELECT count(*) FROM m WHERE left_order IS NULL) AS right_only,
  (SELECT count(*) FROM m WHERE is_cross_source_merged) AS merged, (SELECT count(*) FROM m) AS total"""

DISTRIBUTION = """
SELECT count(*) AS total_records, count(*) FILTER (WHERE quality_level = 'High') AS high_quality,
  count(*) FILTER (WHERE quality_level = 'Medium') AS medium_quality,
  count(*) FILTER (WHERE quality_level = 'Low') AS low_quality,
  round_even(avg(quality_score), 2) AS avg_score, min(quality_score) AS min_score, max(quality_score) AS max_score,
  round_even(high_quality::DOUBLE / total_records * 100, 2) AS high_quality_percent,
  round_even(medium_quality::DOUBLE / total_records * 100, 2) AS medium_quality_percent,
  round_even(low_quality::DOUBLE / total_records * 100, 2) AS low_quality_percent"""


def _fetched(name: str, rel: str) -> str:
    useful = "coalesce(owner_name, '') <> '' OR coalesce(parcel_id, '') <> ''"
    return f"""
SELECT 'fetching' AS section, '{name}_' || key AS key, value::DOUBLE AS value FROM (UNPIVOT (SELECT count(*) AS total_records,
  count(*) FILTER (WHERE {useful}) AS successful_extractions, count(*) FILTER (WHERE NOT ({useful})) AS failed_extractions
  FROM ({rel})) ON COLUMNS(*) INTO NAME key VALUE value)"""


RUN_STATISTICS = f"""{JOB}, m AS ({MERGED}), records AS ({JOB_RECORDS}),
      c AS ({COUNTS}), q AS ({DISTRIBUTION} FROM ({scored('SELECT * FROM records')})),
      d AS (SELECT (SELECT count(*) FROM tagged) AS input_records, (SELECT count(*) FROM records) AS unique_records,
        count(*) AS duplicates_removed, count(DISTINCT duplicate_group) AS duplicate_groups FROM tagged
        WHERE duplicate_group IS NOT NULL),
      v AS (SELECT * FROM (UNPIVOT (SELECT
        (SELECT count(*) FROM ({LEFT}) WHERE {required_ok()}) AS left_valid,
        (SELECT count(*) FROM ({LEFT}) WHERE NOT ({required_ok()})) AS left_invalid,
        (SELECT count(*) FROM ({RIGHT}) WHERE {required_ok()}) AS right_valid,
        (SELECT count(*) FROM ({RIGHT}) WHERE NOT ({required_ok()})) AS right_invalid)
        ON COLUMNS(*) INTO NAME key VALUE value))
      SELECT 'validation' AS section, key, value::DOUBLE AS value FROM v
      UNION ALL SELECT 'merging', key, value::DOUBLE FROM (UNPIVOT c ON COLUMNS(*) INTO NAME key VALUE value)
      UNION ALL SELECT 'deduplication', key, value::DOUBLE FROM (UNPIVOT (SELECT *, duplicates_removed - duplicate_groups
        AS rows_removed FROM d) ON COLUMNS(*) INTO NAME key VALUE value)
      UNION ALL SELECT 'enrichment', key, value::DOUBLE FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM q)
        ON COLUMNS(*) INTO NAME key VALUE value)
      UNION ALL SELECT * FROM ({" UNION ALL ".join(_fetched(n, rel) for n, rel in (("left", LEFT), ("right", RIGHT)))})
      UNION ALL SELECT 'cleaning', replace(key, '_valid', '_cleaned_records'), value::DOUBLE FROM v WHERE key LIKE '%\\_valid' ESCAPE '\\'
      UNION ALL SELECT 'export', 'exported_records', count(*)::DOUBLE FROM records
      UNION ALL SELECT 'run', 'duration_seconds', 1"""

TEXT_SIZE = "coalesce(sum(" + " + ".join(f"length(coalesce({f}, ''))" for f in ("owner_name", "parcel_id", "property_address")) + "), 0)::BIGINT"
REPORT = {
    "all_properties": "SELECT * FROM records",
    "wake_county": PREP_LEFT,
    "orange_county": PREP_RIGHT,
    "duplicates": "SELECT * FROM tagged WHERE duplicate_group IS NOT NULL",
}

# Responses with numbers and lists for texts, nulls, and absent fields; by the rule of what is odd about them.
ODD_ERRORS = f"""
SELECT *, CASE WHEN len(_req) > 0 THEN _req ELSE _types END AS error_list FROM (
SELECT *, list_filter([
    CASE WHEN rec_idx % 17 = 4 OR (rec_idx % 7 <> 1 AND {is_blank('owner_name')}) THEN 'Required field is empty: owner_name' END,
    CASE WHEN rec_idx % 13 = 3 OR {is_blank('property_address')} THEN 'Required field is empty: property_address' END], lambda e: e IS NOT NULL) AS _req,
  list_filter([
    CASE WHEN rec_idx % 7 = 1 THEN 'Field ''owner_name'' has invalid type: expected <class ''str''>, got <class ''int''>' END,
    CASE WHEN rec_idx % 11 = 2 THEN 'Field ''city'' has invalid type: expected <class ''str''>, got <class ''list''>' END], lambda e: e IS NOT NULL) AS _types
FROM ({LEFT}))"""

def hash_of(*fields: str) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce(lower({strip(f)}), '')" for f in fields) + ")"


def nested_replace(c: str, table: dict[str, str]) -> str:
    for pattern, short in table.items():
        c = f"regexp_replace({c}, '{pattern}', '{short}', 'g')"
    return c


JSON_ROWS = f"SELECT rec_idx, CAST({raw_json()} AS JSON) AS j FROM ({ALL})"
_PY = (
    "CASE json_type(j, '$.{f}') WHEN 'VARCHAR' THEN '<class ''str''>' WHEN 'UBIGINT' THEN '<class ''int''>' "
    "WHEN 'BIGINT' THEN '<class ''int''>' WHEN 'DOUBLE' THEN '<class ''float''>' WHEN 'BOOLEAN' THEN '<class ''bool''>' "
    "WHEN 'ARRAY' THEN '<class ''list''>' END"
)


def json_errors() -> str:
    req, other = [], []
    value = lambda f: f"json_extract_string(j, '$.{f}')"
    for f in REQUIRED_FIELDS:
        empty = f"json_type(j, '$.{f}') = 'NULL' OR (json_type(j, '$.{f}') = 'VARCHAR' AND {is_blank(value(f))})"
        req.append(
            f"CASE WHEN NOT json_exists(j, '$.{f}') THEN 'Missing required field: {f}' "
            f"WHEN {empty} THEN 'Required field is empty: {f}' END"
        )
    money = "(<class ''int''>, <class ''float''>, <class ''NoneType''>)"
    for f in CANONICAL_FIELDS:
        good = "'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN', 'NULL'" if f in NUMERIC_FIELDS else "'VARCHAR', 'NULL'"
        want = money if f in NUMERIC_FIELDS else "<class ''str''>"
        other.append(
            f"CASE WHEN json_type(j, '$.{f}') NOT IN ({good}) THEN "
            f"'Field ''{f}'' has invalid type: expected {want}, got ' || {_PY.replace('{f}', f)} END"
        )
    for f, p in FIELD_PATTERNS.items():
        other.append(
            f"CASE WHEN NOT {is_blank(value(f))} AND NOT regexp_matches({strip(value(f))}, '{p}') "
            f"THEN 'Field ''{f}'' does not match required pattern: ' || {strip(value(f))} END"
        )
    keep = lambda xs: f"list_filter([{', '.join(xs)}], lambda e: e IS NOT NULL)"
    return f"""
SELECT rec_idx, len(_e) = 0 AS is_valid, array_to_string(_e, ' | ') AS errors FROM (
SELECT rec_idx, CASE WHEN len(_r) > 0 THEN _r ELSE {keep(other)} END AS _e FROM (
SELECT *, {keep(req)} AS _r FROM ({JSON_ROWS})))"""


RESPONSE_ROWS = f"""
SELECT rec_idx, rec_idx // 200 AS page, owner_name, CASE WHEN rec_idx % 5 <> 0 THEN parcel_id
  ELSE 'R' || rec_idx END AS parcel_id, property_address, '' AS mailing_address, city, 'NC' AS state,
  CASE WHEN rec_idx % 3 = 0 THEN '' ELSE '27601' END AS zip_code, 'Wake' AS county,
  floor(assessed_value)::DOUBLE AS assessed_value,
  CASE WHEN rec_idx % 4 <> 0 THEN CAST(rec_idx + 1700000000 AS VARCHAR) ELSE '' END AS sale_date,
  NULL::DOUBLE AS sale_price, 'Wake County API' AS source, 'https://a.example' AS source_url,
  '2025-01-01T00:00:00' AS extracted_at
FROM ({LEFT}) WHERE rec_idx % 31 <> 0"""

# What the pages of the right records say: white space collapsed, money as whole dollars.
PAGE_ROWS = f"""
SELECT rec_idx, {", ".join(f"{collapse(f)} AS {f}" for f in ("owner_name", "parcel_id", "property_address", "mailing_address", "city", "state", "zip_code"))},
  'Orange' AS county, CASE WHEN assessed_value > 0 THEN floor(assessed_value)::DOUBLE END AS assessed_value, sale_date,
  NULL::DOUBLE AS sale_price, 'Orange County Scraper' AS source, 'https://b.example/p/' || rec_idx AS source_url,
  '2025-01-01T00:00:00' AS extracted_at
FROM ({RIGHT})"""
NO_ROWS = f"SELECT * FROM ({PAGE_ROWS}) WHERE false"

DATE_TEXT = """
CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y')
 WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
 WHEN 4 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 5 THEN strftime(o_orderdate, '%b %d, %Y')
 WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d') END"""
DATE_FORMATS = "['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%d/%m/%Y', '%Y/%m/%d', '%B %d, %Y', '%b %d, %Y']"

# The final semicolon of these four may be missing in HTML.
ENTITIES = """regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '&amp;?', '&', 'g'), '&lt;?', '<', 'g'),
  '&gt;?', '>', 'g'), '&quot;?', '"', 'g')"""


def inner(pattern: str) -> str:
    plain = f"regexp_replace(regexp_extract(html, '{pattern}', 1, 's'), '<[^>]*>', '', 'g')"
    return collapse(ENTITIES.replace("{c}", plain))


HEADING = inner("<article><h1>(.*?)</h1>")
H1 = inner("<h1>(.*?)</h1>")
FIRST_LINK = inner('<nav>.*?<a href="[^"]*">(.*?)</a>')
FOOTER = (
    "trim(regexp_replace(replace(replace("
    + ENTITIES.replace("{c}", "regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")
    + r", '&copy;', '©'), '&middot;', '·'), '\s+', ' ', 'g'))"
)

JOINED = f"""
SELECT coalesce(l._key, r._key) AS _key, CASE WHEN r._key IS NULL THEN 'api_only' WHEN l._key IS NULL THEN 'scraped_only'
  ELSE 'merged' END AS data_source, l.rec_idx AS l_rec_idx, r.rec_idx AS r_rec_idx,
  {', '.join(f'{s}.{f} AS {s}_{f}' for s in 'lr' for f in CANONICAL_FIELDS)}
FROM ({keyed(PREP_LEFT)}) l FULL JOIN ({keyed(PREP_RIGHT)}) r ON l._key = r._key"""


def filled(c: str, f: str) -> str:
    return c if f in NUMERIC_FIELDS else f"CASE WHEN NOT {is_blank(c)} THEN {c} END"


def base_value(f: str) -> str:
    sides = "rl" if f in doc.DETAIL_FIELDS else "lr"
    return "coalesce(" + ", ".join(filled(f"{s}_{f}", f) for s in sides) + ")"


def base_origin(f: str) -> str:
    sides = "rl" if f in doc.DETAIL_FIELDS else "lr"
    names = {"l": "api", "r": "scraped"}
    whens = " ".join(f"WHEN {filled(f'{s}_{f}', f)} IS NOT NULL THEN '{names[s]}'" for s in sides)
    return f"CASE {whens} END"


_ORIGIN_JSON = " || ".join(
    f"CASE WHEN {base_origin(f)} IS NOT NULL THEN ',\"{f}\":\"' || {base_origin(f)} || '\"' ELSE '' END"
    for f in sorted(CANONICAL_FIELDS)
)
BASE_SCORED = scored(
    f"SELECT data_source, {', '.join(f'{base_value(f)} AS {f}' for f in CANONICAL_FIELDS)} FROM ({JOINED})"
)
_NAME_SCORE = "CASE WHEN ln <> '' AND rn <> '' THEN {0} END"

ORACLES: dict[str, str] = {
    "clean_names": f"SELECT rec_idx, owner_name FROM ({name_steps(ALL)})",
    "clean_addresses": f"SELECT rec_idx, property_address, mailing_address FROM ({cleaned(ALL)})",
    "clean_city_state": f"SELECT rec_idx, city, state FROM ({cleaned(ALL)})",
    "clean_zip": f"SELECT rec_idx, zip_code FROM ({cleaned(ALL)})",
    "clean_records": f"SELECT rec_idx, {FIELDS} FROM ({cleaned(ALL)})",
    "trim_text_columns": f"SELECT rec_idx, "
    + ", ".join(f if f in NUMERIC_FIELDS else f"{strip(f)} AS {f}" for f in CANONICAL_FIELDS)
    + f" FROM ({ALL})",
    "match_keys": f"SELECT rec_idx, upper({strip('parcel_id')}) AS match_key FROM ({ALL})",
    "record_hash": f"SELECT rec_idx, {hash_of('owner_name', 'parcel_id', 'property_address', 'sale_date')} AS record_hash "
    f"FROM ({ALL})",
    "document_hash": f"SELECT doc_id, {hash_of('text', 'lang', 'source')} AS record_hash FROM documents",
    "hash_numbers": f"""SELECT rec_idx, {hash_of('parcel_id', 'value_text', 'price_text')} AS record_hash FROM (SELECT *,
      CASE WHEN assessed_value <> 0 THEN assessed_value::VARCHAR END AS value_text,
      CASE WHEN sale_price <> 0 THEN sale_price::VARCHAR END AS price_text FROM ({ALL}))""",
    "parse_dates": f"SELECT o_orderkey, strftime(try_strptime({DATE_TEXT}, {DATE_FORMATS}), '%Y-%m-%d') AS order_date "
    "FROM orders",
    "parse_currency": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL
      WHEN o_orderkey % 7 = 0 THEN floor(o_totalprice) ELSE floor(o_totalprice) + 0.25::DOUBLE END AS price FROM orders""",
    "truncate_text": """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END
      AS short_text FROM documents""",
    "value_or_default": f"""SELECT rec_idx, CASE WHEN {is_blank('property_address')} THEN 'unknown'
      ELSE property_address END AS property_address FROM ({ALL})""",
    "validate_rows": f"SELECT rec_idx, is_valid, array_to_string(error_list, ' | ') AS errors FROM ({checked(ALL)})",
    "validate_strict": "SELECT rec_idx, is_valid, array_to_string(error_list, ' | ') AS errors "
    f"FROM ({checked(ALL, True)})",
    "valid_only": f"SELECT rec_idx, {FIELDS} FROM ({ALL}) WHERE {required_ok()}",
    "invalid_rows": "SELECT rec_idx, array_to_string(error_list, ' | ') AS errors "
    f"FROM ({checked(ALL, True)}) WHERE NOT is_valid",
    "error_summary": f"""SELECT error_type, count(*) AS error_count FROM (
      SELECT rec_idx, generate_subscripts(error_list, 1) AS pos, trim(split_part(unnest(error_list), ':', 1)) AS error_type
      FROM ({checked(ALL, True)}) WHERE NOT is_valid)
      GROUP BY error_type ORDER BY count(*) DESC, min((rec_idx, pos)) LIMIT 5""",
    "stop_on_error": f"""WITH c AS (SELECT -rec_idx AS rec_idx, is_valid FROM ({checked(LEFT)}))
      SELECT rec_idx, is_valid FROM c WHERE rec_idx <= (SELECT min(rec_idx) FROM c WHERE NOT is_valid)""",
    "validation_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS origin, count(*) FILTER (WHERE is_valid) AS valid, "
        f"count(*) FILTER (WHERE NOT is_valid) AS invalid FROM ({checked(rel)})"
        for n, rel in (("left", LEFT), ("right", RIGHT))
    ),
    "validate_json_types": json_errors(),
    "validate_field": f"""SELECT rec_idx, errors = '' AS is_valid, errors FROM (SELECT rec_idx,
      CASE WHEN NOT {is_blank('zip_code')} AND NOT regexp_matches({strip('zip_code')}, '{FIELD_PATTERNS['zip_code']}')
      THEN 'Does not match required pattern: ' || {strip('zip_code')} ELSE '' END AS errors FROM ({ALL}))""",
    "has_keys": """SELECT event_id, list_contains(json_keys(props), 'k') AS has_k,
      list_contains(json_keys(props), 'k') AND list_contains(json_keys(props), 'v') AS has_both FROM events""",
    "response_features": f"SELECT page, 'R' || rec_idx AS reid FROM ({RESPONSE_ROWS})",
    "response_records": f"SELECT {FIELDS} FROM ({RESPONSE_ROWS})",
    "fetch_page": f"SELECT rec_idx, {FIELDS} FROM ({LEFT}) WHERE city = 'RALEIGH' ORDER BY rec_idx LIMIT 50 OFFSET 20",
    "page_texts": f"""SELECT page_id, url, CASE WHEN {HEADING} <> '' THEN {HEADING} ELSE {inner('<title>(.*?)</title>')} END
      AS heading, {FIRST_LINK} AS first_link, '' AS language, {FOOTER} AS footer FROM pages""",
    "page_attributes": """SELECT page_id, trim(regexp_extract(html, '<nav>.*?<a href="([^"]*)"', 1, 's')) AS first_target,
      regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""",
    "page_elements": """SELECT page_id, contains(html, '<nav><ul><li>') AS has_nav, contains(html, '<div class="ad">')
      AS has_ad, false AS has_table FROM pages""",
    "page_links": r"""SELECT page_id, pos - 1 AS pos, CASE WHEN starts_with(href, 'http') THEN href
      ELSE regexp_replace(url, '/[^/]*$', '') || '/' || regexp_replace(href, '^/+', '') END AS link FROM (
      SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (
      SELECT page_id, url, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'),
        '<li><a href="([^"]*)"', 1) AS hrefs FROM pages)) WHERE pos <= 4 AND href <> ''""",
    "page_records": f"""SELECT page_id, {H1} AS owner_name, '' AS parcel_id, {FIRST_LINK} AS city, '' AS state,
      'Orange' AS county, 'Orange County Scraper' AS source, url AS source_url, '2025-01-01T00:00:00' AS extracted_at
      FROM pages WHERE {H1} <> ''""",
    "crawl_all": f"""WITH d AS (SELECT page_id, url, {H1} AS owner_name, {FIRST_LINK} AS city FROM pages)
      SELECT l.page_id // 20 AS listing, row_number() OVER (PARTITION BY l.page_id // 20 ORDER BY l.page_id) - 1 AS pos,
        p.page_id, p.owner_name, p.city, p.url AS source_url
      FROM d l JOIN d p ON l.url = p.url WHERE p.owner_name <> ''""",
    "observed_counts": " UNION ALL ".join(
        f"""SELECT '{n}' AS origin, count(*) AS total_records,
        count(*) FILTER (WHERE rec_idx % 19 <> 0 AND (owner_name <> '' OR parcel_id <> '')) AS successful_extractions,
        count(*) FILTER (WHERE NOT (rec_idx % 19 <> 0 AND (owner_name <> '' OR parcel_id <> ''))) AS failed_extractions FROM ({rel})"""
        for n, rel in (("left", LEFT), ("right", RIGHT))
    ),
    "validate_responses": f"""SELECT 'R' || rec_idx AS reid, len(error_list) = 0 AS is_valid, array_to_string(error_list, ' | ') AS errors
      FROM ({ODD_ERRORS})""",
    "typed_responses": f"""SELECT 'R' || rec_idx AS reid, owner_name, parcel_id, property_address, '' AS mailing_address, city, 'NC' AS state,
      '27601' AS zip_code, 'Wake' AS county, NULL::DOUBLE AS assessed_value, '' AS sale_date, NULL::DOUBLE AS sale_price,
      'Wake County API' AS source, 'https://a.example' AS source_url, '2025-01-01T00:00:00' AS extracted_at
      FROM ({ODD_ERRORS}) WHERE len(error_list) = 0""",
    "fetch_and_map": f"""SELECT {FIELDS} FROM ({RESPONSE_ROWS}) WHERE city = 'RALEIGH' ORDER BY rec_idx LIMIT 50 OFFSET 20""",
    "rows_per_file": f"""SELECT unnest(['csv', 'json']) AS format, n AS rows, true AS within FROM (SELECT count(*) AS n FROM ({PREP_ALL}))""",
    "raw_rows": LEFT,
    "export_formats": f"""SELECT 'csv' AS format, count(*) AS rows, count(nullif(parcel_id, '')) AS filled, '' AS error FROM ({PREP_ALL})
      UNION ALL SELECT 'json', count(*), count(parcel_id), '' FROM ({PREP_ALL})
      UNION ALL SELECT 'xml', 0, 0, 'Unsupported output format: xml'""",
    "source_counts": f"SELECT source, count(*) AS total_records FROM ({ALL}) GROUP BY source",
    "merge_sources": MERGED,
    "merge_preferring_source": merged(PREP_LEFT, PREP_RIGHT, "Wake County API"),
    "merge_keeping_unkeyed": f"""{MERGED} UNION ALL SELECT NULL, rec_idx, NULL, {FIELDS}, NULL FROM ({PREP_LEFT})
      WHERE coalesce(parcel_id, '') = '' UNION ALL SELECT NULL, NULL, rec_idx, {FIELDS}, NULL FROM ({PREP_RIGHT})
      WHERE coalesce(parcel_id, '') = ''""",
    "merge_counts": f"WITH m AS ({MERGED}) {COUNTS}",
    "unkeyed_counts": f"""SELECT 'left' AS side, count(*) AS rows_without_key FROM ({PREP_LEFT}) WHERE
      coalesce(parcel_id, '') = '' UNION ALL SELECT 'right', count(*) FROM ({PREP_RIGHT}) WHERE coalesce(parcel_id, '') = ''""",
    "merge_statistics": f"""WITH m AS ({MERGED})
      SELECT 'totals' AS section, 'total_records' AS key, count(*) AS value FROM m
      UNION ALL SELECT 'totals', 'single_source', count(*) FROM m WHERE is_cross_source_merged IS NULL
      UNION ALL SELECT 'totals', 'cross_source_merged', count(*) FROM m WHERE is_cross_source_merged
      UNION ALL SELECT 'by_source', source, count(*) FROM m GROUP BY source""",
    "cross_source_only": f"SELECT * FROM ({MERGED}) WHERE is_cross_source_merged",
    "records_of_source": f"SELECT rec_idx, {FIELDS} FROM ({ALL}) WHERE source = 'Orange County Scraper'",
    "combine_records": f"SELECT rec_idx, {FIELDS} FROM ({LEFT}) UNION ALL SELECT rec_idx, {FIELDS} FROM ({RIGHT})",
    "exact_groups": f"""SELECT rec_idx, duplicate_group, CASE WHEN duplicate_group IS NOT NULL THEN 'exact' END
      AS duplicate_kind FROM ({exact(PREP_ALL)})""",
    "exact_merged": f"WITH e AS ({exact(PREP_ALL)}) {UNIQUE_PLUS.replace('{rel}', 'e')}",
    "collapse_most_complete": f"""SELECT rec_idx, {FIELDS}, is_merged, duplicate_count
      FROM ({folded_rows(exact(PREP_ALL))})""",
    "collapse_first": f"SELECT rec_idx, {FIELDS} FROM ({exact(PREP_ALL)}) WHERE rec_idx = duplicate_group",
    "collapse_last": f"""SELECT rec_idx, {FIELDS} FROM (SELECT *, max(rec_idx) OVER (PARTITION BY duplicate_group) AS last
      FROM ({exact(PREP_ALL)}) WHERE duplicate_group IS NOT NULL) WHERE rec_idx = last""",
    "unique_rows": f"SELECT rec_idx FROM ({exact(PREP_ALL)}) WHERE duplicate_group IS NULL",
    "exact_statistics": stats(exact(PREP_ALL)),
    "pair_scores": f"""SELECT l_rec_idx, r_rec_idx, {_NAME_SCORE.format(ratio('lt', 'rt'))} AS name_score,
      CASE WHEN la <> '' AND ra <> '' THEN {ratio('lat', 'rat')} END AS address_score,
      CASE WHEN lp <> '' AND rp <> '' THEN CASE WHEN lp = rp THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END AS parcel_score
      FROM (SELECT *, {token_sort('ln')} AS lt, {token_sort('rn')} AS rt, {token_sort('la')} AS lat, {token_sort('ra')} AS rat
      FROM (SELECT l_rec_idx, r_rec_idx, {', '.join(
          f"upper({strip(f'{s}_{f}')}) AS {s}{a}" for s in 'lr'
          for f, a in (('owner_name', 'n'), ('property_address', 'a'), ('parcel_id', 'p')))}
      FROM ({JOINED}) WHERE data_source = 'merged'))""",
    "fuzzy_long_names": f"WITH {fuzzy_ctes(adapter.long_names_sql())} SELECT lo, hi FROM fuzzy_edges",
    "fuzzy_pairs": f"WITH {fuzzy_ctes(PREP_ALL)} SELECT lo, hi FROM fuzzy_edges",
    "fuzzy_groups": f"""WITH {fuzzy_group_ctes(PREP_ALL)} SELECT b.rec_idx, g.duplicate_group,
      CASE WHEN g.ord IS NOT NULL THEN 'fuzzy' END AS duplicate_kind FROM ({PREP_ALL}) b
      LEFT JOIN fuzzy_groups g ON b.rec_idx = g.ord""",
    "find_duplicates": f"{TAGGED} SELECT rec_idx, duplicate_group, duplicate_kind FROM tagged",
    "deduplicate": f"{TAGGED} {UNIQUE_PLUS.replace('{rel}', 'tagged')}",
    "duplicate_members": f"""{TAGGED} SELECT rec_idx, {FIELDS}, duplicate_group, duplicate_kind FROM tagged
      WHERE duplicate_group IS NOT NULL""",
    "duplicate_statistics": TAGGED + stats("SELECT * FROM tagged"),
    "score_records": f"SELECT rec_idx, quality_score, quality_level, completeness_percent FROM ({SCORED})",
    "quality_distribution": f"{DISTRIBUTION} FROM ({SCORED})",
    "field_coverage": " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE {has_value(f)}) AS filled_count, "
        f"count(*) FILTER (WHERE NOT {has_value(f)}) AS missing_count, "
        f"round_even(count(*) FILTER (WHERE {has_value(f)})::DOUBLE / count(*) * 100, 2) AS coverage_percent, {w} AS weight "
        f"FROM ({PREP_ALL})"
        for f, w in QUALITY_WEIGHTS.items()
    ),
    "filter_quality": f"""SELECT rec_idx, quality_score FROM ({SCORED})
      WHERE quality_level IN ('Medium', 'High') AND quality_score >= 85""",
    "sort_quality": f"SELECT rec_idx, quality_score FROM ({SCORED}) ORDER BY quality_score DESC, rec_idx",
    "top_quality": f"""SELECT rec_idx, owner_name, quality_score FROM ({SCORED})
      ORDER BY quality_score DESC, rec_idx LIMIT 10""",
    "quality_rank": f"""SELECT rec_idx, quality_score, row_number() OVER (ORDER BY quality_score DESC, rec_idx)
      AS quality_rank FROM ({SCORED})""",
    # An empty text and no value look alike in CSV.
    "export_csv": "SELECT rec_idx, "
    + ", ".join(f if f in NUMERIC_FIELDS else f"nullif({f}, '') AS {f}" for f in CANONICAL_FIELDS)
    + f", quality_score, quality_level, completeness_percent FROM ({SCORED})",
    "export_json": f"""SELECT rec_idx, {FIELDS}, quality_score, quality_level, completeness_percent FROM ({SCORED})""",
    "quality_band": f"""SELECT rec_idx, CASE WHEN quality_score >= 80 THEN 'high' WHEN quality_score >= 50 THEN 'medium'
      ELSE 'low' END AS quality_band FROM ({SCORED})""",
    "long_statistics": f"""WITH m AS ({MERGED}), c AS ({COUNTS})
      SELECT 'Merging' AS section, 'Left Only' AS key, left_only::VARCHAR AS value FROM c
      UNION ALL SELECT 'Merging', 'Right Only', right_only::VARCHAR FROM c
      UNION ALL SELECT 'Merging', 'Merged', merged::VARCHAR FROM c
      UNION ALL SELECT 'Merging', 'Total', total::VARCHAR FROM c""",
    "stage_snapshot": f"SELECT rec_idx, {FIELDS} FROM ({PREP_ALL})",
    "linked_records": f"""{JOB}, records AS ({JOB_RECORDS}) SELECT {FIELDS}, is_cross_source_merged, is_merged,
      duplicate_count, quality_score, quality_level, completeness_percent FROM ({scored('SELECT * FROM records')})""",
    "run_ranked": ranked_job(MERGED),
    "run_resumed": ranked_job(MERGED),
    "run_landed": ranked_job(merged(prepared(RESPONSE_ROWS), prepared(PAGE_ROWS))),
    "run_one_source": f"""{job(merged(prepared(NO_ROWS), prepared(PAGE_ROWS)))}, records AS ({JOB_RECORDS})
      SELECT 'responses' AS failed_source, count(*) AS records, max(quality_score) AS best_score FROM ({scored('SELECT * FROM records')})""",
    "run_statistics": RUN_STATISTICS,
    "report_parts": f"""{JOB}, records AS ({JOB_RECORDS})
      {" UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS rows, {TEXT_SIZE} AS text_size FROM ({rel})" for part, rel in REPORT.items())}
      UNION ALL SELECT 'statistics', count(*), sum(length(section) + length(key))::BIGINT FROM ({RUN_STATISTICS})""",
    "run_duplicates": f"{JOB} SELECT {FIELDS}, is_cross_source_merged FROM tagged WHERE duplicate_group IS NOT NULL",
    "address_units": rf"""SELECT rec_idx,
      CASE WHEN rec_idx % 3 = 0 THEN property_address ELSE {collapse('property_address')} END AS property_address,
      CASE WHEN rec_idx % 3 = 0 THEN '' WHEN rec_idx % 2 = 0 THEN CAST(rec_idx % 9 AS VARCHAR) ELSE '4B' END AS unit_number
      FROM ({ALL})""",
    "address_variants": r"SELECT rec_idx, array_to_string(list_transform(string_split(upper("
    + collapse("regexp_replace(property_address, '(North|Street)', 'N.E. \\1 STR', 'g')")
    + "), ' '), lambda w: CASE w "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in doc.STREET_VARIANTS.items())
    + f" ELSE w END), ' ') AS property_address FROM ({ALL})",
    "owner_strict": "SELECT rec_idx, "
    + collapse(
        "regexp_replace("
        + nested_replace(
            f"upper({collapse(chr(39).join(['owner_name || CASE WHEN rec_idx % 2 = 0 THEN ', ' & Sons, Inc.', ' ELSE ', ' L.L.C.', ' END']))})",
            doc.ENTITY_FORMS,
        )
        + ", '"
        + doc.DROPPED_CHARACTERS.replace("'", "''")
        + "', '', 'g')"
    )
    + f" AS owner_name FROM ({ALL})",
    "parcel_ids": rf"""SELECT rec_idx, CASE WHEN length(p) < 10 THEN lpad(p, 10, '0') ELSE p END AS parcel_id
      FROM (SELECT rec_idx, regexp_replace(upper(parcel_id), '[-\s]', '', 'g') AS p FROM ({ALL}))""",
    "keep_originals": f"""SELECT a.rec_idx, a.owner_name, c.owner_name AS owner_name_normalized, a.property_address,
      c.property_address AS property_address_normalized FROM ({ALL}) a JOIN ({cleaned(ALL)}) c ON a.rec_idx = c.rec_idx""",
    "exact_address_groups": f"""SELECT rec_idx, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1
      THEN min(rec_idx) OVER (PARTITION BY k) END AS duplicate_group FROM (
      SELECT rec_idx, CASE WHEN {address('property_address')} <> '' THEN {address('property_address')} || '|' ||
        upper({strip('city')}) || '|' || zip_code END AS k FROM ({ALL}))""",
    "best_of_group": f"""WITH e AS (SELECT *, {' + '.join(
        f"CASE WHEN {has_value(f)} THEN 0 ELSE 1 END" for f in CANONICAL_FIELDS)} AS empty FROM ({exact(PREP_ALL)})),
      k AS (SELECT duplicate_group, first(rec_idx ORDER BY empty, extracted_at DESC, rec_idx) AS kept,
        first(parcel_id ORDER BY empty, extracted_at DESC, rec_idx) AS kept_parcel FROM e
        WHERE duplicate_group IS NOT NULL GROUP BY duplicate_group)
      SELECT rec_idx, coalesce(rec_idx <> kept, false) AS is_duplicate, CASE WHEN rec_idx <> kept THEN kept_parcel END
        AS duplicate_of, CASE WHEN rec_idx <> kept THEN 'exact_parcel_match' END AS dedup_reason
      FROM e LEFT JOIN k ON e.duplicate_group = k.duplicate_group""",
    "base_merge": f"""SELECT _key AS merge_key, data_source, {', '.join(f'{base_value(f)} AS {f}' for f in CANONICAL_FIELDS)},
      '{{' || substr({_ORIGIN_JSON}, 2) || '}}' AS field_sources FROM ({JOINED})""",
    "field_origins": "SELECT field, origin, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {base_origin(f)} AS origin FROM ({JOINED})" for f in CANONICAL_FIELDS)
    + ") WHERE origin IS NOT NULL GROUP BY field, origin",
    "merge_conflicts": f"""SELECT * FROM (SELECT l_rec_idx, r_rec_idx, owner_score, owner_score < 90 AS owner_conflict,
      la <> '' AND ra <> '' AND la <> ra AS address_conflict FROM (
      SELECT *, {ratio('lt', 'rt')} AS owner_score FROM (
      SELECT l_rec_idx, r_rec_idx, {token_sort(f"upper({strip('l_owner_name')})")} AS lt,
        {token_sort(f"upper({strip('r_owner_name')})")} AS rt, {address('l_property_address')} AS la,
        {address('r_property_address')} AS ra FROM ({JOINED}) WHERE data_source = 'merged')))
      WHERE owner_conflict OR address_conflict""",
    "enrichment_statistics": f"""SELECT count(*) AS total_records, count(*) FILTER (WHERE data_source = 'merged')
      AS merged_records, sum(CASE WHEN data_source = 'merged' THEN {' + '.join(
          f"CASE WHEN {base_origin(f)} = 'scraped' THEN 1 ELSE 0 END" for f in CANONICAL_FIELDS)} END)::BIGINT AS fields_added,
      round_even(merged_records::DOUBLE / total_records * 100, 2) AS enrichment_rate FROM ({JOINED})""",
    "summary_metrics": f"""WITH b AS ({BASE_SCORED}) SELECT metric, value FROM (
      SELECT 'records' AS metric, count(*)::DOUBLE AS value FROM b
      UNION ALL SELECT 'enrichment_rate', round_even(count(*) FILTER (WHERE data_source = 'merged')::DOUBLE / count(*) * 100, 2) FROM b
      UNION ALL SELECT 'avg_score', round_even(avg(quality_score), 2) FROM b
      UNION ALL SELECT 'avg_score_' || data_source, round_even(avg(quality_score), 2) FROM b GROUP BY data_source
      {' '.join(f"UNION ALL SELECT 'filled_percent_{f}', round_even(count(*) FILTER (WHERE {has_value(f)})::DOUBLE / count(*) * 100, 2) FROM b" for f in CANONICAL_FIELDS)})""",
    "crawl_records": f"""WITH d AS (SELECT page_id, url, {H1} AS owner_name, {FIRST_LINK} AS city FROM pages)
      SELECT p.page_id, p.owner_name, p.city, p.url AS source_url FROM d l JOIN d p ON l.url = p.url
      WHERE l.page_id % 20 < 10 AND p.owner_name <> '' ORDER BY l.page_id // 20, l.page_id % 20, p.page_id LIMIT 100""",
    "record_urls": f"""SELECT rec_idx, CASE WHEN NOT {is_blank('parcel_id')} THEN 'https://data.wake.gov/property/' ||
      parcel_id END AS record_url FROM ({ALL})""",
    "bonus_score": f"""SELECT rec_idx, bonus_score, CASE WHEN bonus_score >= 90 THEN 'complete' WHEN bonus_score >= 70
      THEN 'enhanced' ELSE 'basic' END AS enrichment_level FROM (SELECT rec_idx, least(100, {' + '.join(
          f"CASE WHEN {has_value(f)} THEN {w} ELSE 0 END" for f, w in doc.BONUS_WEIGHTS.items() if f in CANONICAL_FIELDS)}
      + CASE WHEN county = 'Orange' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(zip_code, '^[0-9]{{5}}$') THEN 5 ELSE 0 END)
      AS bonus_score FROM ({PREP_ALL}))""",
    "owner_types": rf"""SELECT rec_idx, CASE WHEN regexp_matches(upper(owner_name),
      '\b(LLC|CORP|INC|TRUST|LP|LLP|PARTNERSHIP)\b') THEN 'entity' ELSE 'individual' END AS owner_type FROM ({PREP_ALL})""",
    "record_notes": f"""SELECT rec_idx, concat_ws('; ', CASE WHEN county = 'Orange' THEN 'Enriched with scraped data' END,
      CASE WHEN NOT ({has_value('sale_price')} AND {has_value('sale_date')}) THEN 'Missing sale data' END,
      CASE WHEN quality_score - 20 < 60 THEN 'Low quality score - missing fields' END) AS notes FROM ({SCORED})""",
    "quality_issues": " UNION ALL ".join(
        f"SELECT rec_idx, parcel_id, 'CRITICAL' AS issue_type, 'Missing required field: {f}' AS description, quality_score "
        f"FROM ({scored(ALL)}) WHERE {is_blank(f)} OR upper({strip(f)}) = 'N/A'"
        for f in REQUIRED_FIELDS
    )
    + f""" UNION ALL SELECT rec_idx, parcel_id, 'WARNING', 'Low quality score', quality_score FROM ({scored(ALL)})
      WHERE quality_score < 60""",
    "record_flags": rf"""SELECT rec_idx, rec_idx % 5 = 0 AS is_po_box, owner_name = upper(owner_name) AND
      regexp_matches(owner_name, '[A-Z]') AS is_suspicious_name, zip_code = 'N/A' AS zip_not_available FROM ({ALL})""",
    "range_errors": """SELECT rec_idx, concat_ws(' | ',
      CASE WHEN try_strptime(sale_date, '%Y-%m-%d') > DATE '2024-02-01' THEN 'sale_date is in the future' END,
      CASE WHEN assessed_value < 0 THEN 'assessed_value is negative' END,
      CASE WHEN sale_price < 0 THEN 'sale_price is negative' END,
      CASE WHEN state NOT IN ('NC') THEN 'state is unknown' END,
      CASE WHEN rec_idx % 600 + 1500 NOT BETWEEN 1600 AND 2024 THEN 'year_built is out of range' END) AS range_errors
      FROM ("""
    + ALL
    + ")",
}
