"""Merge and exact de-duplication in one step, without forming pairs.

Merging gives one row per left and right row of a key, and exact de-duplication
on the same key then folds them into one row again. For a key with many rows on
both sides that is a product of rows which only serves to be folded. Here the
folded row is computed from one aggregate per side instead; the outcome is the
same, and the work is linear in the rows however often a key occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import is_blank
from recordloom.operators.merge import HOT_ROWS, KEY, hot_keys, key_counts, keyed, merge_keyed, value_fields
from recordloom.sinks.snapshots import cut

ORDER = "merge_order"


def _with_order(merged: DataFrame) -> DataFrame:
    return merged.withColumn(ORDER, F.struct("merge_key", "left_order", "right_order")).drop(
        "merge_key", "left_order", "right_order"
    )


def _side_summary(rows: DataFrame, fields: list[T.StructField], order: str, prefix: str) -> DataFrame:
    """Per key: the first row, and per field the longest texts or first value."""
    aggs = [
        F.min_by(F.struct(*[f.name for f in fields]), F.col(order)).alias(f"{prefix}first"),
        F.min(order).alias(f"{prefix}order"),
    ]
    for f in fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            longest = F.struct(-F.length(c), F.col(order))
            aggs.append(F.min_by(c, F.when(c != "", longest)).alias(f"{prefix}any_{f.name}"))
            aggs.append(F.min_by(c, F.when(~is_blank(c), longest)).alias(f"{prefix}{f.name}"))
        else:
            aggs.append(F.min_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"{prefix}{f.name}"))
    return rows.groupBy(KEY, "l", "r", "n", "_ragged").agg(*aggs)


def _folded(field: T.StructField) -> Column:
    """The value that survives among all pairs of a key.

    Pairs run in the order (left, right) and the first longest text wins. Each
    pair keeps the longer text, the left one on ties. So the longest side wins,
    and on equal lengths the right side does unless the first left row already
    has that length.
    """
    name = field.name
    a, b, first = F.col(f"l_{name}"), F.col(f"r_{name}"), F.col(f"l_first.{name}")
    both = (F.col("l") > 0) & (F.col("r") > 0)
    if not isinstance(field.dataType, T.StringType):
        return F.when(both, F.coalesce(first, b, a)).otherwise(F.coalesce(a, b))
    any_a, any_b = F.col(f"l_any_{name}"), F.col(f"r_any_{name}")
    one_side = F.coalesce(any_a, any_b, F.lit(""))
    if name in ("source", "source_url"):
        return F.concat_ws(" + " if name == "source" else " | ", any_a, any_b)
    if name == "extracted_at":
        even = F.coalesce(F.greatest(first, F.col(f"r_first.{name}")), F.lit(""))
        return F.when(F.col("_ragged"), F.col("_time")).when(both, even).otherwise(one_side)
    right_wins = (F.length(b) > F.length(a)) | (
        (F.length(b) == F.length(a)) & ~(F.coalesce(F.length(first), F.lit(-1)) == F.length(a))
    )
    longest = F.when(a.isNull(), b).when(b.isNull(), a).when(right_wins, b).otherwise(a)
    return F.when(both, F.coalesce(longest, F.lit(""))).otherwise(one_side)


def _join_by_key(rows: DataFrame, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows with the columns of a table that has one row per key.

    Rows of the ``hot`` keys, if those are few enough to be broadcast, stay where
    they are; the others are shuffled without them.
    """
    if hot is None:
        return rows.join(table, KEY)
    cold_rows = rows.join(hot, KEY, "left_anti").join(table, KEY)
    return cold_rows.unionByName(rows.join(hot, KEY).join(table, KEY))


def _ragged_times(left: DataFrame, right: DataFrame, keys: DataFrame, order: str, hot: DataFrame | None) -> DataFrame:
    """(key, time) that survives where extraction times differ in length.

    A pair keeps the greater of its two texts, and the first longest of those
    wins. Which length that is follows from the greatest text per length and the
    least text per side; the first left row that reaches it, and then the first
    right row, follow from one pass over each side.
    """

    def times(df: DataFrame, side: str) -> DataFrame:
        time = F.coalesce("extracted_at", F.lit("")).alias("_t")
        return df.select(KEY, F.lit(side).alias("_side"), time, F.col(order).alias("_ord"))

    lt, rt = times(left, "l"), times(right, "r")
    is_left = F.col("_side") == "l"
    per_length = (
        _join_by_key(lt.union(rt), keys, hot)
        .groupBy(KEY, "_side", F.length("_t").alias("_len"))
        .agg(F.max("_t").alias("_max"), F.min("_t").alias("_min"))
    )
    limits = per_length.groupBy(KEY).agg(
        F.min(F.when(is_left, F.col("_min"))).alias("_min_l"),
        F.min(F.when(~is_left, F.col("_min"))).alias("_min_r"),
        F.collect_list(F.struct("_side", "_len", "_max")).alias("_lengths"),
    )
    reached = F.filter(
        "_lengths",
        lambda x: x["_max"] >= F.when(x["_side"] == "l", F.col("_min_r")).otherwise(F.col("_min_l")),
    )
    limits = limits.withColumn("_m", F.array_max(F.transform(reached, lambda x: x["_len"])))
    greatest_right = F.filter("_lengths", lambda x: (x["_side"] == "r") & (x["_len"] == F.col("_m")))
    limits = limits.select(KEY, "_min_r", "_m", F.get(greatest_right, F.lit(0))["_max"].alias("_max_r"))

    reaches = ((F.length("_t") == F.col("_m")) & (F.col("_t") >= F.col("_min_r"))) | F.coalesce(
        F.col("_t") < F.col("_max_r"), F.lit(False)
    )
    first_left = (
        _join_by_key(lt, limits, hot).filter(reaches).groupBy(KEY, "_m").agg(F.min_by("_t", "_ord").alias("_x"))
    )
    pair = F.greatest("_x", "_t")
    return (
        _join_by_key(rt, first_left, hot)
        .filter(F.length(pair) == F.col("_m"))
        .groupBy(KEY)
        .agg(F.min_by(pair, "_ord").alias("_time"))
    )


def merge_and_fold(
    left: DataFrame, right: DataFrame, key: str = "parcel_id", order: str = "rec_idx", hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(single, folded).

    ``single`` holds the merged rows that are alone with their key, with their
    place in the merged order as ``merge_order``; ``folded`` holds one row per
    key with several merged rows, with ``is_merged`` and ``duplicate_count``.
    The row counts per key are written down first; they are what the later joins
    are chosen by.
    """
    types = value_fields(left, right, order)
    left, right = [
        df.select(
            order, *[(F.col(f) if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in types.items()]
        )
        for df in (left, right)
    ]
    counts = cut(key_counts(left, right, key), "key_counts")
    fields = [f for f in left.schema.fields if f.name != order]
    helpers = ["l", "r", "n", "_ragged"]
    lk, rk = keyed(left, key), keyed(right, key)

    # A blank key is merged on but is no key for exact duplicates.
    blank = F.col(KEY) == ""
    many = counts.filter((F.col("n") > 1) & ~blank)

    hot = hot_keys(many, hot_rows)
    hot = None if hot is None else hot.select(KEY)

    alone = counts.filter((F.col("n") == 1) | blank)
    ls, rs = lk, rk
    if hot is not None:
        ls, rs = [s.join(hot, KEY, "left_anti") for s in (lk, rk)]
    ls, rs = [s.join(alone, KEY).drop(*helpers) for s in (ls, rs)]
    # Every pair of the blank key is a row of its own, so its pairs are dealt over tasks.
    single = _with_order(merge_keyed(ls, rs, hot_keys(alone, hot_rows), order, hot_rows=hot_rows))

    sides = _side_summary(_join_by_key(lk, many, hot), fields, order, "l_").join(
        _side_summary(_join_by_key(rk, many, hot), fields, order, "r_"), [KEY, "l", "r", "n", "_ragged"], "full_outer"
    )
    ragged = many.filter("_ragged").select(KEY)
    if ragged.isEmpty():
        sides = sides.withColumn("_time", F.lit(None).cast("string"))
    else:
        sides = sides.join(_ragged_times(lk, rk, ragged, order, hot), KEY, "left")
    at = F.struct(
        F.col(KEY).alias("merge_key"), F.col("l_order").alias("left_order"), F.col("r_order").alias("right_order")
    )
    return single, sides.select(
        *[_folded(f).alias(f.name) for f in fields],
        F.when((F.col("l") > 0) & (F.col("r") > 0), F.lit(True)).alias("is_cross_source_merged"),
        at.alias(ORDER),
        F.lit(True).alias("is_merged"),
        F.col("n").alias("duplicate_count"),
    )


def exact_members(
    left: DataFrame, right: DataFrame, key: str = "parcel_id", order: str = "rec_idx", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All merged rows of keys with several: every pair, by definition. Only
    needed where the duplicates themselves are exported."""
    counts = cut(key_counts(left, right, key).filter((F.col("n") > 1) & (F.col(KEY) != "")), "repeated_keys")
    hot = hot_keys(counts, hot_rows)
    hot_names = None if hot is None else hot.select(KEY)
    helpers = ["l", "r", "n", "_ragged"]
    lk, rk = [_join_by_key(keyed(s, key), counts, hot_names).drop(*helpers) for s in (left, right)]
    return _with_order(merge_keyed(lk, rk, hot, order, hot_rows=hot_rows))
