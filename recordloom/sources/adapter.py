"""Property records derived from the customer and supplier tables.

The statements are plain SQL that Spark and other engines read alike. They
plant comma names, spaced suffixes, blank keys and addresses, shared parcel
ids, zero values, odd ZIPs and states, keys of both sources in other case and
padding, and pairs of records that differ by a typing error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LAST = "'SMITH JONES BROWN WILSON TAYLOR CLARK LEWIS WALKER YOUNG ALLEN BAKER'"
_FIRST = "'JOHN MARY ROBERT LINDA JAMES SUSAN DAVID'"

LEFT_SQL = f"""
SELECT k AS rec_idx,
  CASE k % 6 WHEN 0 THEN ln || ', ' || fn WHEN 1 THEN '  ' || lower(fn) || '   ' || ln
             WHEN 2 THEN ln || ' Holdings L L C' WHEN 3 THEN ln || ' Family Trust'
             WHEN 4 THEN fn || ' O''' || ln ELSE fn || ' ' || ln END AS owner_name,
  CASE WHEN k % 23 = 0 THEN ''
       ELSE 'WK-' || CAST(1000 + k - (CASE WHEN k % 17 = 0 AND k > 0 THEN 1 ELSE 0 END) AS STRING) END AS parcel_id,
  CASE WHEN k % 29 = 0 THEN '  '
       ELSE CAST(100 + k AS STRING) || ' North  ' || st || ' ' || sfx END AS property_address,
  '' AS mailing_address,
  CASE nk % 3 WHEN 0 THEN 'RALEIGH' WHEN 1 THEN 'chapel hill' ELSE 'winston-salem' END AS city,
  CASE nk % 4 WHEN 0 THEN 'North Carolina' WHEN 1 THEN 'nc' WHEN 2 THEN 'Texas' ELSE 'NC' END AS state,
  CASE k % 5 WHEN 0 THEN '27601' WHEN 1 THEN '276011234' WHEN 2 THEN '27514-12'
             WHEN 3 THEN '7601' ELSE 'N/A' END AS zip_code,
  'Wake' AS county,
  CASE WHEN k % 13 = 0 THEN 0.0 ELSE bal * 100 END AS assessed_value,
  CASE WHEN k % 4 = 0 THEN NULL ELSE '2024-01-15' END AS sale_date,
  CASE WHEN k % 4 = 0 THEN NULL ELSE bal * 110 END AS sale_price,
  'Wake County API' AS source, 'https://a.example' AS source_url, '2025-01-01T00:00:00' AS extracted_at
FROM (
  SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS nk, c_acctbal AS bal,
    split_part({_LAST}, ' ', CAST(c_custkey % 11 + 1 AS INT)) AS ln,
    split_part({_FIRST}, ' ', CAST(c_custkey % 7 + 1 AS INT)) AS fn,
    split_part('Main Oak Chapel Elm Cedar Lake Ridge Park Maple', ' ', CAST(c_custkey % 9 + 1 AS INT)) AS st,
    split_part('Street Avenue Road Drive Lane Court', ' ', CAST(c_custkey % 6 + 1 AS INT)) AS sfx
  FROM customer
) n
"""

RIGHT_SQL = f"""
SELECT CAST(c_custkey AS BIGINT) AS rec_idx,
  split_part({_FIRST}, ' ', CAST(c_custkey % 7 + 1 AS INT)) || ' ' ||
  split_part({_LAST}, ' ', CAST(c_custkey % 11 + 1 AS INT)) AS owner_name,
  ' wk-' || CAST(1000 + c_custkey AS STRING) || ' ' AS parcel_id,
  CAST(100 + c_custkey AS STRING) || ' North Extension Street' AS property_address,
  CAST(c_custkey AS STRING) || ' Mailing Avenue' AS mailing_address,
  'Chapel Hill' AS city, 'NC' AS state, '27514' AS zip_code, 'Orange' AS county,
  c_acctbal * 90 AS assessed_value, '2024-02-20' AS sale_date, CAST(NULL AS DOUBLE) AS sale_price,
  'Orange County Scraper' AS source, 'https://b.example' AS source_url, '2025-02-01T00:00:00' AS extracted_at
FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT CAST(1000000 + s_suppkey * 2 + v AS BIGINT),
  CASE WHEN v = 0 THEN 'MARGARET WELLINGTON ' ELSE 'MARGARET  WELINGTON ' END ||
    split_part('ADAMS BENNETT CARTER DIXON EDWARDS FOSTER GRAHAM HUGHES', ' ', CAST(s_suppkey % 8 + 1 AS INT)),
  'OR-' || CAST(2000 + s_suppkey * 2 + v AS STRING),
  CAST(100 + s_suppkey * 37 AS STRING) ||
    CASE WHEN v = 0 THEN ' Martin Luther King Boulevard' ELSE ' Martin Luther  Kng Blvd' END,
  '', 'carrboro', 'NC', '27510', 'Orange', s_acctbal * 100, '', CAST(NULL AS DOUBLE),
  'Orange County Scraper', 'https://b.example', '2025-02-02T00:00:00'
FROM (SELECT s_suppkey, s_acctbal, unnest_v AS v FROM supplier {{two}}) t
"""

# Two names without an address for every third customer: some 60 to 120 symbols of common words, and the same with
# up to 12 symbols taken out and up to 5 put in.
LONG_NAMES_SQL = f"""
SELECT k * 2 + v AS rec_idx, '' AS property_address,
  CASE WHEN v = 0 THEN nm
    ELSE substr(nm, 1, CAST(10 + k % 20 AS INT)) || substr('XYZZY', 1, CAST(k % 6 AS INT)) || substr(nm, CAST(11 + k % 20 + k % 13 AS INT))
  END AS owner_name
FROM (
  SELECT k, unnest_v AS v, split_part({_LAST}, ' ', CAST(k % 11 + 1 AS INT)) || ' ' ||
    split_part({_FIRST}, ' ', CAST(k * 5 % 7 + 1 AS INT)) || ' AND ' || split_part({_LAST}, ' ', CAST(k * 7 % 11 + 1 AS INT)) || ' ' ||
    split_part('REVOCABLE LIVING FAMILY IRREVOCABLE TESTAMENTARY', ' ', CAST(k * 3 % 5 + 1 AS INT)) || ' TRUST OF ' ||
    split_part('DURHAM RALEIGH CHARLOTTE GREENSBORO ASHEVILLE WILMINGTON', ' ', CAST(k * 11 % 6 + 1 AS INT)) || ' NORTH CAROLINA ' ||
    substr('PROPERTIES HOLDINGS INVESTMENTS DEVELOPMENT PARTNERSHIP GROUP', 1, CAST(k * 13 % 44 AS INT)) || ' ' || CAST(k * 17 % 1000 AS STRING) AS nm
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer WHERE c_custkey % 3 = 1) c {{two}}
) t
"""

# The two rows per supplier or customer, in each dialect.
_TWO = {
    "spark": "LATERAL VIEW explode(array(0, 1)) x AS unnest_v",
    "plain": ", (VALUES (0), (1)) x(unnest_v)",
}


def right_sql(dialect: str = "plain") -> str:
    return RIGHT_SQL.format(two=_TWO[dialect])


def _views(spark: SparkSession, sf_dir: str) -> None:
    """The two tables, dealt out by their key: a file of some megabytes is one task or a few, and what is done to a
    row costs far more than reading it. The number is given, as such small rows would be put together again."""
    parts = 3 * spark.sparkContext.defaultParallelism
    for t, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(parts, key).createOrReplaceTempView(t)


def left_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(LEFT_SQL)


def right_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(right_sql("spark"))


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(LONG_NAMES_SQL.format(two=_TWO["spark"]))


def long_names_sql() -> str:
    return LONG_NAMES_SQL.format(two=_TWO["plain"])


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources as one table with unique ``rec_idx`` (left even, right odd)."""
    left, right = left_records(spark, sf_dir), right_records(spark, sf_dir)
    return left.withColumn("rec_idx", left.rec_idx * 2).unionByName(
        right.withColumn("rec_idx", right.rec_idx * 2 + 1)
    )


def all_sql() -> str:
    """The same as plain SQL."""
    return f"""
SELECT * REPLACE (rec_idx * 2 AS rec_idx) FROM ({LEFT_SQL}) l
UNION ALL
SELECT * REPLACE (rec_idx * 2 + 1 AS rec_idx) FROM ({right_sql()}) r
"""
