"""Duplicate detection and collapse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import ADDRESS_THRESHOLD, EXACT_MATCH_FIELDS, NAME_THRESHOLD
from recordloom.functions.similarity import normal_form, similarity
from recordloom.functions.text import match_key
from recordloom.operators.groups import greedy_groups
from recordloom.operators.joins import join_where_keyed
from recordloom.operators.similar import similar_pairs
from recordloom.sinks.snapshots import cut

GROUP = "duplicate_group"
KIND = "duplicate_kind"

#: Names are compared before addresses where there are so many times fewer of them.
FEWER = 4


def exact_key(df: DataFrame, fields: list[str] = EXACT_MATCH_FIELDS) -> Column:
    """Normalised values joined by ``|``; null when a field is null or empty, a
    number is zero, or nothing is left of the key."""
    parts = []
    present = F.lit(True)
    for f in fields:
        if isinstance(df.schema[f].dataType, T.StringType):
            present = present & (F.col(f) != "")
        else:
            present = present & (F.col(f) != 0)
        parts.append(match_key(F.col(f)))
    key = F.concat_ws("|", *parts)
    return F.when(present & (key != ""), key)


def exact_groups(df: DataFrame, order: str = "rec_idx", fields: list[str] = EXACT_MATCH_FIELDS) -> DataFrame:
    """(key, group, rows) for keys that occur more than once. Rows are counted
    before the shuffle, so a key that a third of all rows share is no burden."""
    keyed = df.select(exact_key(df, fields).alias("_key"), F.col(order).alias("_ord")).filter("_key is not null")
    counts = keyed.groupBy("_key").agg(F.min("_ord").alias("_exact"), F.count("*").alias("_rows"))
    return counts.filter("_rows > 1").select("_key", "_exact")


def mark_exact(df: DataFrame, order: str = "rec_idx", fields: list[str] = EXACT_MATCH_FIELDS) -> DataFrame:
    """Add ``_exact``: the first row of the exact group, null for other rows.

    Each key joins one row, and rows without a key are kept apart.
    """
    groups = exact_groups(df, order, fields)
    keyed = df.withColumn("_key", exact_key(df, fields))
    return join_where_keyed(keyed, groups, ["_key"], order).drop("_key")


def _forms(matcher: str, name: str, address: str) -> dict[str, Column]:
    raw_name = match_key(F.coalesce(F.col(name), F.lit("")))
    raw_address = match_key(F.coalesce(F.col(address), F.lit("")))
    return {
        "_n": F.when(raw_name != "", normal_form(raw_name, matcher)),
        "_a": F.when(raw_address != "", normal_form(raw_address, matcher)),
    }


def _vertices(df: DataFrame, order: str) -> DataFrame:
    """One vertex per distinct (name, address): rows that agree on both have the
    same matches, so only the first row of each and their number are kept."""
    return (
        df.filter("_n is not null")
        .groupBy("_n", "_a")
        .agg(F.min(order).alias("v"), F.count("*").alias("rows"))
    )


def _repeated(texts: DataFrame) -> DataFrame:
    """Texts of kinds that hold more than one, with their number: only those can make a pair."""
    several = texts.groupBy("kind").agg(F.count("*").alias("texts_of_kind")).filter("texts_of_kind > 1")
    return texts.join(several, "kind")


def _located_pairs(vertices: DataFrame, name_threshold: int, address_threshold: int) -> DataFrame:
    """Matching pairs (v, w) of vertices that have an address.

    Both texts must be similar, so those of one kind are found first, among the distinct ones, and the others
    then only meet at one text of the first kind. Addresses are the more telling ones, and a long or common name has no
    partners all over the data; so they come first, unless the names are far fewer: then many vertices share a name,
    and among all numbers of a street many are similar of which hardly any have similar names.
    """
    located = vertices.filter("_a is not null").select("v", "_n", "_a")
    texts = located.agg(F.count_distinct("_n").alias("names"), F.count_distinct("_a").alias("addresses")).first()
    first = ("name", "_n", name_threshold), ("address", "_a", address_threshold)
    if FEWER * texts["names"] > texts["addresses"]:
        first = first[::-1]
    (kind, at, threshold), (_, of, other_threshold) = first
    return _stepped_pairs(located.select("v", F.col(at).alias("_at"), F.col(of).alias("_of")), kind, threshold, other_threshold)


def _stepped_pairs(located: DataFrame, kind: str, at_threshold: int, of_threshold: int) -> DataFrame:
    """Matching pairs (v, w) of vertices with two texts ``_at`` and ``_of``.

    Similar ``_at`` are found among the distinct ones, and a vertex steps to those similar to its own that more
    vertices have. The ``_of`` then meet at one ``_at`` only.
    """
    distinct = located.groupBy(F.col("_at").alias("text")).agg(F.count("*").alias("uses"))
    texts = distinct.select(F.lit(kind).alias("kind"), F.lit(at_threshold).alias("threshold"), "text", "uses")
    similar = cut(similar_pairs(cut(texts, "places")), "similar")
    rare_first = F.col("uses_a") <= F.col("uses_b")
    rare = F.when(rare_first, F.col("a")).otherwise(F.col("b"))
    other = F.when(rare_first, F.col("b")).otherwise(F.col("a"))
    moved = located.join(similar.select(rare.alias("_at"), other.alias("_at2")), "_at").select("v", F.col("_at2").alias("_at"), "_of")

    at = cut(located.withColumn("_home", F.lit(True)).union(moved.withColumn("_home", F.lit(False))), "located")
    there = at.groupBy(F.col("_at").alias("kind"), F.col("_of").alias("text")).agg(F.max("_home").alias("asks"))
    there = cut(_repeated(there.withColumn("threshold", F.lit(of_threshold))), "there")
    alike = cut(similar_pairs(there).select(F.col("kind").alias("_at"), "a", "b"), "similar")

    home = at.filter("_home").select(F.col("v").alias("w"), "_at", "_of")
    same = at.filter("not _home").join(home, ["_at", "_of"]).select("v", "w")
    # One of the two is at home at this text; two that are meet once.
    both_ways = alike.select("_at", F.col("a").alias("_of"), F.col("b").alias("_m"), F.lit(True).alias("_up")).union(
        alike.select("_at", F.col("b"), F.col("a"), F.lit(False))
    )
    step = home.join(both_ways, ["_at", "_of"]).select("w", F.col("_m").alias("_of"), "_at", "_up")
    return same.union(step.join(at, ["_at", "_of"]).filter(~F.col("_home") | F.col("_up")).select("v", "w"))


def _bare_pairs(vertices: DataFrame, name_threshold: int) -> DataFrame:
    """Matching pairs (v, w) of which one has no address: the name decides alone.

    At most one vertex of a name has no address, so a name takes it along, and pairs of names give those of such vertices as
    they are. Names that also occur with an address have a number, and only pairs with one of them meet more vertices.
    """
    bare, located = F.col("_a").isNull(), F.col("_a").isNotNull()
    names = vertices.groupBy(F.col("_n").alias("text")).agg(F.min(F.when(bare, F.col("v"))).alias("v"), F.max(located).alias("located"))
    number = F.when(F.col("located"), F.monotonically_increasing_id()).alias("name")
    asks = F.col("v").isNotNull().alias("asks")
    texts = names.select(F.lit("name").alias("kind"), F.lit(name_threshold).alias("threshold"), "text", F.struct("v", number).alias("uses"), asks)
    texts = cut(texts, "names")
    similar = similar_pairs(texts, with_texts=False)
    sides = [F.col(f"uses_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("v", "name")]
    similar = cut(similar.select(*sides), "similar")
    pairs = similar.filter("v_a is not null and v_b is not null").select(F.col("v_a").alias("v"), F.col("v_b").alias("w"))
    if texts.filter("uses.name is not null").isEmpty():
        return pairs
    steps = [similar.select(F.col(f"v_{s}").alias("v"), F.col(f"name_{o}").alias("name")) for s, o in ("ab", "ba")]
    steps = [*steps, texts.select("uses.v", "uses.name")]
    steps = reduce(DataFrame.unionByName, [s.filter("v is not null and name is not null") for s in steps])
    others = vertices.filter(located).select(F.col("v").alias("w"), F.col("_n").alias("text"))
    others = others.join(texts.select("text", "uses.name"), "text").select("w", "name")
    return pairs.unionByName(steps.join(others, "name").select("v", "w"))


def match_edges(vertices: DataFrame, name_threshold: int, address_threshold: int) -> DataFrame:
    """All matching vertex pairs (lo, hi).

    The work grows with the number of similar texts, not with the square of the
    vertices that share a name, an address or a street.
    """
    bare, located = (not vertices.filter(f"_a is {which}").isEmpty() for which in ("null", "not null"))
    pairs = [_located_pairs(vertices, name_threshold, address_threshold)] if located or not bare else []
    pairs = reduce(DataFrame.union, [*pairs, *([_bare_pairs(vertices, name_threshold)] if bare else [])])
    return pairs.select(F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi"))


def fuzzy_pairs(
    df: DataFrame,
    order: str = "rec_idx",
    name: str = "owner_name",
    address: str = "property_address",
    name_threshold: int = NAME_THRESHOLD,
    address_threshold: int = ADDRESS_THRESHOLD,
    matcher: str = "token_sort_ratio",
) -> DataFrame:
    """Matching pairs of distinct (name, address) texts, each given by its first
    row. Rows that agree on both texts match as well and are not listed."""
    vertices = cut(_vertices(df.withColumns(_forms(matcher, name, address)), order), "vertices")
    return match_edges(vertices, name_threshold, address_threshold)


def find_duplicates(
    df: DataFrame,
    order: str = "rec_idx",
    use_exact: bool = True,
    use_fuzzy: bool = True,
    exact_fields: list[str] = EXACT_MATCH_FIELDS,
    name: str = "owner_name",
    address: str = "property_address",
    name_threshold: int = NAME_THRESHOLD,
    address_threshold: int = ADDRESS_THRESHOLD,
    matcher: str = "token_sort_ratio",
) -> DataFrame:
    """Add ``duplicate_group`` (the ``order`` of the first member) and
    ``duplicate_kind`` (exact or fuzzy); both null for unique rows.

    Exact groups come first; fuzzy groups are formed among the other rows: in
    order, each open row takes all later open rows that match it. ``order`` must
    be unique. With ``use_fuzzy`` the match graph is computed at once.
    """
    given = df
    if use_fuzzy:
        # The rows are read for the vertices and for the result, and either time for the exact keys as well: what makes
        # them, and the forms, would be computed four times.
        df = cut(df.withColumns(_forms(matcher, name, address)), "rows")
    order_type = df.schema[order].dataType
    marked = mark_exact(df, order, exact_fields) if use_exact else df.withColumn("_exact", F.lit(None).cast(order_type))
    if not use_fuzzy:
        kind = F.when(F.col("_exact").isNotNull(), F.lit("exact"))
        return marked.withColumns({GROUP: F.col("_exact"), KIND: kind}).drop("_exact")

    # Rows of exact groups get no forms, and so take no part in the fuzzy phase.
    marked = marked.withColumns({k: F.when(F.col("_exact").isNull(), F.col(k)) for k in ("_n", "_a")})
    vertices = cut(_vertices(marked.select(order, "_n", "_a"), order), "vertices")
    edges = cut(match_edges(vertices, name_threshold, address_threshold), "edges")
    taken = cut(greedy_groups(edges), "taken")
    labels = taken.union(taken.select(F.col("seed").alias("v"), "seed").distinct())
    fuzzy = (
        vertices.join(labels, "v", "left")
        .filter("seed is not null or rows > 1")
        .select("_n", "_a", F.coalesce("seed", "v").alias("_fuzzy"))
    )
    tagged = join_where_keyed(marked, fuzzy, ["_n", "_a"], order)
    kind = F.when(F.col("_exact").isNotNull(), F.lit("exact")).when(F.col("_fuzzy").isNotNull(), F.lit("fuzzy"))
    return tagged.withColumns({GROUP: F.coalesce("_exact", "_fuzzy"), KIND: kind}).select(*given.columns, GROUP, KIND)


def _most_complete(field: T.StructField, order: str) -> Column:
    """Longest text, first on ties; other types the first value; ``""`` for
    text and null otherwise when no row has a value."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        best = F.min_by(c, F.when(c != "", F.struct(-F.length(c), F.col(order))))
        return F.coalesce(best, F.lit("")).alias(field.name)
    return F.min_by(c, F.when(c.isNotNull(), F.col(order))).alias(field.name)


def collapse_groups(tagged: DataFrame, order: str = "rec_idx", strategy: str = "most_complete") -> DataFrame:
    """One row per duplicate group.

    ``first`` and ``last`` give that member as it is; ``most_complete`` (also
    used for any other word) picks per field and adds ``is_merged`` and
    ``duplicate_count``. All are aggregates with a partial step before the
    shuffle, so a group may hold a third of all rows.
    """
    members = tagged.filter(F.col(GROUP).isNotNull())
    fields = [f for f in tagged.schema.fields if f.name not in (GROUP, KIND)]
    if strategy in ("first", "last"):
        pick = F.min_by if strategy == "first" else F.max_by
        row = pick(F.struct(*[f.name for f in fields]), F.col(order))
        return members.groupBy(GROUP).agg(row.alias("_row")).select(*[f"_row.{f.name}" for f in fields])
    aggs = [F.min(order).alias(order) if f.name == order else _most_complete(f, order) for f in fields]
    return (
        members.groupBy(GROUP)
        .agg(*aggs, F.count("*").alias("duplicate_count"))
        .withColumn("is_merged", F.lit(True))
        .select(*[f.name for f in fields], "is_merged", "duplicate_count")
    )


def deduplicate(
    df: DataFrame, order: str = "rec_idx", strategy: str = "most_complete", **options
) -> tuple[DataFrame, DataFrame]:
    """(records, duplicates): unique rows with one row per group, and all
    members of all groups. The grouping is written once and read by both."""
    tagged = cut(find_duplicates(df, order, **options), "tagged")
    return deduplicated(tagged, order, strategy), tagged.filter(F.col(GROUP).isNotNull())


def deduplicated(tagged: DataFrame, order: str = "rec_idx", strategy: str = "most_complete") -> DataFrame:
    """Unique rows and one row per group."""
    unique = tagged.filter(F.col(GROUP).isNull()).drop(GROUP, KIND)
    return unique.unionByName(collapse_groups(tagged, order, strategy), allowMissingColumns=True)


def duplicate_statistics(tagged: DataFrame) -> DataFrame:
    """Number of groups and members, and average, largest and smallest group
    (null smallest, zeros else, when there is no group)."""
    sizes = tagged.filter(F.col(GROUP).isNotNull()).groupBy(GROUP).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("total_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_duplicates"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_group_size"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_group_size"),
        F.min("n").alias("min_group_size"),
    )


def pair_scores(
    pairs: DataFrame,
    matcher: str = "token_sort_ratio",
    name: str = "owner_name",
    address: str = "property_address",
    parcel: str = "parcel_id",
) -> DataFrame:
    """Scores of record pairs held as ``l_*`` and ``r_*`` columns: name and
    address 0 to 100, parcel 100 or 0; null where a side has no value."""

    def form(side: str, field: str) -> Column:
        raw = match_key(F.col(f"{side}_{field}"))
        return F.when(raw != "", normal_form(raw, matcher))

    lp, rp = match_key(F.col(f"l_{parcel}")), match_key(F.col(f"r_{parcel}"))
    return pairs.withColumns(
        {
            "name_score": similarity(form("l", name), form("r", name)),
            "address_score": similarity(form("l", address), form("r", address)),
            "parcel_score": F.when((lp != "") & (rp != ""), F.when(lp == rp, F.lit(100.0)).otherwise(F.lit(0.0))),
        }
    )
