"""Merging two sources on a key, with survivorship per field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import is_blank, match_key
from recordloom.sinks.snapshots import cut

KEY = "_key"
HOT_KEYS = 1000
HOT_ROWS = 100_000
WORK = 100


def keyed(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Add the match key; rows whose key is null or empty are left out.

    A key of blanks is kept (as the empty match key), as the rule tests the
    value before it is trimmed.
    """
    raw = F.col(key).cast("string")
    return df.filter(raw != "").withColumn(KEY, match_key(raw))


def unkeyed(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    """The rows that ``keyed`` leaves out."""
    return df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) == "")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _survivor(dtype: T.DataType, a: Column, b: Column, prefer: Column | None) -> Column:
    """The value that survives; ``prefer`` is 1, 2 or null per row."""
    if not isinstance(dtype, T.StringType):
        both = F.coalesce(F.when(prefer == 2, b), a, b) if prefer is not None else F.coalesce(a, b)
        return both
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    if prefer is not None:
        longer = F.when(prefer == 1, a).when(prefer == 2, b).otherwise(longer)
    return (
        F.when(is_blank(a), F.when(is_blank(b), F.lit("")).otherwise(b)).when(is_blank(b), a).otherwise(longer)
    )


def merged_field(field: str, dtype: T.DataType, a: Column, b: Column, prefer: Column | None = None) -> Column:
    """One field of a merged pair. Sources and urls are joined, the later
    extraction time wins, and other fields follow the survivorship rule."""
    if field == "source":
        return F.concat_ws(" + ", _filled(a), _filled(b))
    if field == "source_url":
        return F.concat_ws(" | ", _filled(a), _filled(b))
    if field == "extracted_at":
        return F.coalesce(F.greatest(_filled(a), _filled(b)), F.lit(""))
    return _survivor(dtype, a, b, prefer)


def count_of(c: Column) -> Column:
    """A count that may be a number of pairs: a product of two BIGINTs fits."""
    return c.cast("decimal(38,0)")


def pair_count(l: Column, r: Column) -> Column:
    """``l * r`` without overflow."""
    return l.cast("decimal(19,0)") * r.cast("decimal(19,0)")


def key_counts(left: DataFrame, right: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Per key: rows on each side (``l``, ``r``), merged rows (``n``), and
    whether a key of both sides has extraction times of several lengths."""

    def side(df: DataFrame, name: str) -> DataFrame:
        time = F.col("extracted_at") if "extracted_at" in df.columns else F.lit("")
        return keyed(df, key).select(
            KEY, F.lit(name).alias("_side"), F.length(F.coalesce(time, F.lit(""))).alias("_len")
        )

    is_left = F.col("_side") == "l"
    counts = side(left, "l").union(side(right, "r")).groupBy(KEY).agg(
        F.count_if(is_left).alias("l"),
        F.count_if(~is_left).alias("r"),
        (F.min("_len") != F.max("_len")).alias("_ragged"),
    )
    both = (F.col("l") > 0) & (F.col("r") > 0)
    merged = F.when(both, pair_count(F.col("l"), F.col("r"))).otherwise(count_of(F.col("l") + F.col("r")))
    return counts.select(KEY, "l", "r", merged.alias("n"), (both & F.col("_ragged")).alias("_ragged"))


def hot_keys(counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of more than ``hot_rows`` rows, or of more pairs than a task should
    form (``hot_rows`` times WORK), or None, however many rows there are in all.
    Up to HOT_KEYS of them are marked for broadcast; more are joined by key. Of the
    counts only those of hot keys are written down."""
    size = F.col("l") + F.col("r")
    hot = cut(counts.filter((size > hot_rows) | (pair_count(F.col("l"), F.col("r")) > hot_rows * WORK)), "hot_keys")
    some = hot.count()
    if not some:
        return None
    return F.broadcast(hot) if some <= HOT_KEYS else hot


def value_fields(left: DataFrame, right: DataFrame, order: str) -> dict[str, T.DataType]:
    """Value columns of either side and their types, left ones first."""
    types = {f.name: f.dataType for f in [*right.schema.fields, *left.schema.fields]}
    names = dict.fromkeys([*left.columns, *right.columns])
    return {f: types[f] for f in names if f not in (KEY, order)}


def _side(df: DataFrame, fields: dict[str, T.DataType], order: str, prefix: str, *also: str) -> DataFrame:
    cols = [F.col(f) if f in df.columns else F.lit(None).cast(t).alias(f) for f, t in fields.items()]
    return df.select(
        KEY,
        F.lit(True).alias(f"{prefix}here"),
        F.col(order).alias(f"{prefix}order"),
        *[c.alias(f"{prefix}{f}") for c, f in zip(cols, fields)],
        *also,
    )


def _merged_rows(joined: DataFrame, fields: dict[str, T.DataType], prefer_source: str | None) -> DataFrame:
    """Merged columns of records held as ``l_*`` and ``r_*``; a record without a
    partner passes unchanged."""
    prefer = None
    if prefer_source is not None:
        prefer = F.when(F.col("l_source") == prefer_source, 1).when(F.col("r_source") == prefer_source, 2)
    has_left, both = F.col("l_here").isNotNull(), F.col("l_here") & F.col("r_here")

    def value(f: str, t: T.DataType) -> Column:
        a, b = F.col(f"l_{f}"), F.col(f"r_{f}")
        return F.when(both, merged_field(f, t, a, b, prefer)).when(has_left, a).otherwise(b).alias(f)

    return joined.select(
        F.col(KEY).alias("merge_key"),
        F.col("l_order").alias("left_order"),
        F.col("r_order").alias("right_order"),
        *[value(f, t) for f, t in fields.items()],
        F.when(both, F.lit(True)).alias("is_cross_source_merged"),
    )


def _join_cold(lk: DataFrame, rk: DataFrame, fields: dict[str, T.DataType], order: str) -> DataFrame:
    """Records of both sides by key, none of which is hot: one full outer join,
    one shuffle per side."""
    return _side(lk, fields, order, "l_").join(_side(rk, fields, order, "r_"), KEY, "full_outer")


def _join_hot(
    lk: DataFrame, rk: DataFrame, hot: DataFrame, fields: dict[str, T.DataType], order: str, hot_rows: int
) -> DataFrame:
    """The same for hot keys, whose rows meet their counts by broadcast if there are few such keys.

    Rows of a key of one side only are not shuffled at all. The pairs of a key of
    both sides form a grid of parts: a left row goes to one part row and all part
    columns, a right row to one column and all rows. So the pairs of one key are
    spread over tasks, and the repeats are few beside the pairs.
    """
    cell = max(hot_rows // 10, 1)

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / cell).cast("int")

    grid = hot.select(KEY, "l", "r", parts("l").alias("_rows"), parts("r").alias("_cols"))
    helpers = ["l", "r", "_rows", "_cols"]
    ls = _side(lk.join(grid, KEY), fields, order, "l_", *helpers)
    rs = _side(rk.join(grid, KEY), fields, order, "r_", *helpers)

    def one(place: str, n: str) -> Column:
        return F.pmod(F.xxhash64(place), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    lefts = ls.filter("r > 0").withColumn("_row", one("l_order", "_rows")).withColumn("_col", every("_cols"))
    rights = rs.filter("l > 0").withColumn("_col", one("r_order", "_cols")).withColumn("_row", every("_rows"))
    pairs = lefts.drop(*helpers).join(rights.drop(*helpers), [KEY, "_row", "_col"])
    alone = ls.filter("r = 0").unionByName(rs.filter("l = 0"), allowMissingColumns=True)
    return pairs.drop("_row", "_col").unionByName(alone.drop(*helpers), allowMissingColumns=True)


def join_keyed(
    lk: DataFrame, rk: DataFrame, hot: DataFrame | None, order: str = "rec_idx", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Full outer join of frames that carry their match key, as ``l_*`` and
    ``r_*`` columns with ``l_here`` and ``r_here``; ``hot`` as ``hot_keys`` gives it."""
    fields = value_fields(lk, rk, order)
    if hot is None:
        return _join_cold(lk, rk, fields, order)
    lc, rc = [s.join(hot.select(KEY), KEY, "left_anti") for s in (lk, rk)]
    return _join_cold(lc, rc, fields, order).unionByName(
        _join_hot(lk, rk, hot, fields, order, hot_rows), allowMissingColumns=True
    )


def join_sources(
    left: DataFrame, right: DataFrame, key: str = "parcel_id", order: str = "rec_idx", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Full outer join of two sources on the normalised key. Rows per key are
    counted first, so that hot keys can be treated apart."""
    hot = hot_keys(key_counts(left, right, key), hot_rows)
    return join_keyed(keyed(left, key), keyed(right, key), hot, order, hot_rows)


def merge_keyed(
    lk: DataFrame,
    rk: DataFrame,
    hot: DataFrame | None,
    order: str = "rec_idx",
    prefer_source: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``merge_sources`` for frames that carry their match key already."""
    return _merged_rows(join_keyed(lk, rk, hot, order, hot_rows), value_fields(lk, rk, order), prefer_source)


def merge_sources(
    left: DataFrame,
    right: DataFrame,
    key: str = "parcel_id",
    order: str = "rec_idx",
    prefer_source: str | None = None,
    keep_unkeyed: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Full outer merge on the normalised key.

    Keys on both sides give one merged row per left and right row; other keys
    pass their rows unchanged. The result carries ``merge_key``, ``left_order``
    and ``right_order``, which fix its order.
    """
    out = _merged_rows(
        join_sources(left, right, key, order, hot_rows), value_fields(left, right, order), prefer_source
    )
    return out.unionByName(_passed(left, right, key, order), allowMissingColumns=True) if keep_unkeyed else out


def _passed(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows without a key, in the shape of merged rows."""

    def part(df: DataFrame, lo: str | None, ro: str | None) -> DataFrame:
        rest = unkeyed(df, key)
        none = F.lit(None).cast(df.schema[order].dataType)
        return rest.select(
            F.lit(None).cast("string").alias("merge_key"),
            (F.col(lo) if lo else none).alias("left_order"),
            (F.col(ro) if ro else none).alias("right_order"),
            *[F.col(f) for f in df.columns if f != order],
        )

    return part(left, order, None).unionByName(part(right, None, order), allowMissingColumns=True)


def merge_counts(left: DataFrame, right: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Rows only on the left, only on the right, merged, and in total, from row
    counts per key: no pair is formed, however often a key occurs."""
    lc = keyed(left, key).groupBy(KEY).agg(F.count("*").alias("l"))
    rc = keyed(right, key).groupBy(KEY).agg(F.count("*").alias("r"))
    each = lc.join(rc, KEY, "full_outer").na.fill(0, ["l", "r"])

    def total(c: Column) -> Column:
        return count_of(F.coalesce(F.sum(c), F.lit(0)))

    return each.agg(
        total(F.when(F.col("r") == 0, F.col("l"))).alias("left_only"),
        total(F.when(F.col("l") == 0, F.col("r"))).alias("right_only"),
        total(pair_count(F.col("l"), F.col("r"))).alias("merged"),
    ).withColumn(
        "total", count_of(F.col("left_only") + F.col("right_only") + F.col("merged"))
    )


def unkeyed_counts(left: DataFrame, right: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Rows per side that the merge leaves out for want of a key."""
    return (
        unkeyed(left, key).agg(F.lit("left").alias("side"), F.count("*").alias("rows_without_key"))
    ).unionByName(unkeyed(right, key).agg(F.lit("right").alias("side"), F.count("*").alias("rows_without_key")))


def combine(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; nothing is removed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_name() -> Column:
    return F.coalesce(F.col("source"), F.lit("Unknown"))


def from_source(df: DataFrame, name: str) -> DataFrame:
    """Rows of one source; a missing source is called ``Unknown``."""
    return df.filter(source_name() == name)


def _is_cross(df: DataFrame) -> Column:
    if "is_cross_source_merged" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("is_cross_source_merged"), F.lit(False))


def cross_source_only(df: DataFrame) -> DataFrame:
    return df.filter(_is_cross(df))


def merge_statistics(df: DataFrame) -> DataFrame:
    """Long table: total, single-source and merged rows, and rows per source.

    One pass: rows are counted per source and merge flag, and the totals are
    sums over that small table.
    """
    return _statistics(df.groupBy(source_name().alias("source"), _is_cross(df).alias("cross")).agg(count_of(F.count("*")).alias("n")))


def pair_statistics(left: DataFrame, right: DataFrame, key: str = "parcel_id") -> DataFrame:
    """``merge_statistics`` of the merged sources without forming a pair: rows are
    counted per key and source on each side, and the counts of a key are multiplied."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        counts = keyed(df, key).groupBy(KEY, "source").agg(F.count("*").alias(f"{prefix}n"))
        return counts.withColumnRenamed("source", f"{prefix}source")

    both = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    source = F.when(both, merged_field("source", T.StringType(), F.col("l_source"), F.col("r_source")))
    each = side(left, "l_").join(side(right, "r_"), KEY, "full_outer").select(
        F.coalesce(source, F.coalesce("l_source", "r_source"), F.lit("Unknown")).alias("source"),
        both.alias("cross"),
        F.when(both, pair_count(F.col("l_n"), F.col("r_n"))).otherwise(count_of(F.coalesce("l_n", "r_n"))).alias("n"),
    )
    return _statistics(each.groupBy("source", "cross").agg(F.sum("n").alias("n")))


def _statistics(each: DataFrame) -> DataFrame:
    """The long table from counts per source and merge flag."""
    none = count_of(F.lit(0))
    totals = each.agg(
        count_of(F.coalesce(F.sum("n"), none)).alias("total_records"),
        count_of(F.coalesce(F.sum(F.when(~F.col("cross"), F.col("n"))), none)).alias("single_source"),
        count_of(F.coalesce(F.sum(F.when(F.col("cross"), F.col("n"))), none)).alias("cross_source_merged"),
    ).unpivot([], ["total_records", "single_source", "cross_source_merged"], "key", "value")
    by_source = each.groupBy(F.col("source").alias("key")).agg(count_of(F.sum("n")).alias("value"))
    return totals.select(F.lit("totals").alias("section"), "key", "value").unionByName(
        by_source.select(F.lit("by_source").alias("section"), "key", "value")
    )
