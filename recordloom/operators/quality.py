"""Quality scores, their statistics, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import (
    LEVEL_ORDER,
    NUMERIC_FIELDS,
    QUALITY_HIGH,
    QUALITY_MEDIUM,
    QUALITY_WEIGHTS,
)
from recordloom.functions.text import is_blank
from recordloom.sinks.snapshots import cut


def has_value(df: DataFrame, field: str) -> Column:
    """Not null, not blank, and not zero in the money fields."""
    if field not in df.columns:
        return F.lit(False)
    c = F.col(field)
    if isinstance(df.schema[field].dataType, T.StringType):
        return ~is_blank(c)
    if field in NUMERIC_FIELDS:
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def _points(df: DataFrame, weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for f, w in weights.items():
        total = total + F.when(has_value(df, f), F.lit(float(w))).otherwise(F.lit(0.0))
    return total


def score_expr(df: DataFrame, weights: dict[str, float] = QUALITY_WEIGHTS) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), _points(df, weights))), 2)


def level_expr(score: Column) -> Column:
    return F.when(score >= QUALITY_HIGH, "High").when(score >= QUALITY_MEDIUM, "Medium").otherwise("Low")


def completeness_expr(df: DataFrame, weights: dict[str, float] = QUALITY_WEIGHTS) -> Column:
    if not weights:
        return F.lit(0.0)
    filled = F.lit(0)
    for f in weights:
        filled = filled + F.when(has_value(df, f), 1).otherwise(0)
    return F.bround(filled / F.lit(float(len(weights))) * F.lit(100.0), 2)


def score_records(
    df: DataFrame, weights: dict[str, float] = QUALITY_WEIGHTS, timestamp: bool = True
) -> DataFrame:
    """Add ``quality_score``, ``quality_level``, ``completeness_percent`` and,
    unless switched off, ``enriched_at``."""
    out = df.withColumns(
        {"quality_score": score_expr(df, weights), "completeness_percent": completeness_expr(df, weights)}
    )
    out = out.withColumn("quality_level", level_expr(F.col("quality_score")))
    if timestamp:
        out = out.withColumn("enriched_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return out


def field_coverage(df: DataFrame, weights: dict[str, float] = QUALITY_WEIGHTS) -> DataFrame:
    """Filled and missing rows per weighted field, from one aggregation; no
    rows at all when the input is empty."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(has_value(df, f)).alias(f) for f in weights]
    ).filter("_rows > 0")
    long = counts.unpivot("_rows", list(weights), "field", "filled_count")
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(w))])
    return long.select(
        "field",
        "filled_count",
        (F.col("_rows") - F.col("filled_count")).alias("missing_count"),
        F.bround(F.col("filled_count") / F.col("_rows") * 100.0, 2).alias("coverage_percent"),
        weight[F.col("field")].alias("weight"),
    )


def quality_distribution(df: DataFrame) -> DataFrame:
    """One row: rows per level, shares, and the average, lowest and highest
    score; zeros, and null shares, when the input is empty."""
    levels = {"high_quality": "High", "medium_quality": "Medium", "low_quality": "Low"}
    out = df.agg(
        F.count("*").alias("total_records"),
        *[F.count_if(F.col("quality_level") == v).alias(k) for k, v in levels.items()],
        F.coalesce(F.bround(F.avg("quality_score"), 2), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.bround(F.min("quality_score"), 2), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.bround(F.max("quality_score"), 2), F.lit(0.0)).alias("max_score"),
    )
    rows = F.col("total_records")
    return out.withColumns(
        {f"{k}_percent": F.when(rows > 0, F.bround(F.try_divide(F.col(k), rows) * 100.0, 2)) for k in levels}
    )


def filter_by_quality(df: DataFrame, min_level: str = "Low", min_score: float | None = None) -> DataFrame:
    """Rows at or above a level and, if given, a score; an unknown level counts
    as Low and a missing score as 0."""
    level = F.lit(0)
    for name, n in LEVEL_ORDER.items():
        level = F.when(F.col("quality_level") == name, F.lit(n)).otherwise(level)
    out = df.filter(level >= LEVEL_ORDER.get(min_level, 0))
    if min_score is not None:
        out = out.filter(F.coalesce(F.col("quality_score"), F.lit(0.0)) >= min_score)
    return out


def _score(df: DataFrame) -> Column:
    return F.coalesce(F.col("quality_score"), F.lit(0.0))


def sort_by_quality(df: DataFrame, order: str = "rec_idx", descending: bool = True) -> DataFrame:
    """Rows by score; ties keep the input order either way."""
    by = _score(df).desc() if descending else _score(df).asc()
    return df.orderBy(by, order)


def top_quality(df: DataFrame, n: int = 10, order: str = "rec_idx") -> DataFrame:
    return sort_by_quality(df, order).limit(n)


def add_rank(df: DataFrame, order: str = "rec_idx") -> DataFrame:
    """Add ``quality_rank`` 1..n by score, ties by ``order``, which may be of any type that sorts and must be unique.

    The rows are written once with their score, then dealt out by ranges of (score, order), so a score that a third of
    the rows share is cut like any other, and written in order with their place in the range. What comes before a range
    is the sum of the ranges ahead of it: one number a task, the only thing that the driver sees.
    """
    scored = cut(df.withColumn("_s", _score(df)), "scored")
    in_order = [F.desc("_s"), F.asc_nulls_first(order)]
    dealt = scored.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    ranges = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    # The id holds the number of the range above 33 bits and the place in it below.
    ranges = ranges.withColumns({"_range": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = sorted(ranges.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = [(r["_range"], sum(x["n"] for x in sizes[:k])) for k, r in enumerate(sizes)]
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before bigint")
    ranked = ranges.join(F.broadcast(offsets), "_range")  # as many rows as tasks
    return ranked.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias("quality_rank"))


def quality_band(score: Column) -> Column:
    """Band of a score for display: high, medium or low; no score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= QUALITY_HIGH, "high").when(s >= QUALITY_MEDIUM, "medium").otherwise("low")
