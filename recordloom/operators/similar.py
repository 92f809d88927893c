"""Similarity self-join: all pairs of texts whose score reaches a threshold.

Two texts of total length s that score at least T differ by at most K(s)
insertions and deletions.

Texts at a small distance (up to 12) meet by their lengths, which fix both K and how many symbols
either has to lose: of two texts whose lengths differ by d, the longer one (K + d) / 2, the
shorter one (K - d) / 2. So each text looks for partners of its own length, shorter by d and
longer by d, and those that look for each other share keys:

* Where neither loses more than one symbol, the keys are the text without one symbol, for each
  of its places, or the text itself. Equal keys are matches, whatever the texts have in common.
* Else the symbols are dealt into G groups, and one insertion or deletion changes the
  subsequence of one group only. So with K changes at least G - K groups keep their
  subsequence, and two matching texts agree on some choice of G - K groups. Each text emits
  one key per choice: itself with the symbols of all other groups removed. Equal keys make
  candidates, without loss. The fewer symbols a key leaves out, the fewer texts that differ
  in a number only share it: up to three changes it keeps five eighths of them.

Texts at a larger distance (from about 55 symbols at threshold 90) share no key that
many others lack, above all names of common words. They are compared with all others of
their kind that are as long, in cells of two parts of the texts (``cells``). Only pairs that match
leave a cell, and without their texts where these are not asked for. A cell is bounded and
stands for itself, so the work is spread whatever the texts
have in common; it grows with the square of the long texts of a kind.

Texts are distinct beforehand, so copies of one text do not meet either. The joins are
inner equi-joins, which the runtime can split on skew.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.similarity import lcs_length, max_distance, ratio
from recordloom.operators.cells import matches_of_cell
from recordloom.sinks.snapshots import cut

# The symbols of processed text, frequent ones apart so that groups are even.
SYMBOLS = " eanrtsoilk0123456789dcmhupgbyvfwjxzq_"

# Groups kept per choice, by distance. More groups make keys more selective, and more numerous.
_KEEP = {2: 4, 3: 5, 4: 4} | dict.fromkeys(range(5, 13), 2)
_WIDEST = max(_KEEP)

# Long texts of a part, and tasks that their cells are dealt to at most.
PART = 8192
TASKS = 4096

# Kinds of up to so many texts are compared as they are: a text meets fewer others there than it has keys.
FEW = 64

_PAIR = [("x", "text", "a"), ("y", "text", "b"), ("x", "uses", "uses_a"), ("y", "uses", "uses_b")]
_ORDERED = [(s, "y" if s == "x" else "x", c, n) for s, c, n in _PAIR]
_COLUMNS = ["kind", "threshold", "text", "uses", "asks", "n"]


def _choices() -> list[tuple[int, int, str]]:
    """(distance, number, symbols to remove) for every choice of groups."""
    out = []
    for distance, keep in _KEEP.items():
        groups = distance + keep
        members = ["".join(SYMBOLS[i::groups]) for i in range(groups)]
        for n, kept in enumerate(combinations(range(groups), keep)):
            out.append((distance, n, "".join(m for g, m in enumerate(members) if g not in kept)))
    return out


def _choice_table(spark: SparkSession) -> DataFrame:
    """All choices as a table: as many rows whatever the data."""
    return spark.createDataFrame(_choices(), "family int, choice int, removed string")


def _ranged(texts: DataFrame) -> DataFrame:
    """Texts with their length ``n`` and the least and largest distance (``_lo``,
    ``_hi``) over all partners that are short or long enough to match."""
    c = (F.lit(100.5) - F.col("threshold")) / 100.0 + F.lit(1e-9)
    n = F.length("text")
    lowest = F.greatest(F.floor(2 * c * n / (1 + c)) - 1, F.lit(1)).cast("int")
    highest = F.floor(2 * c * n / (1 - c)).cast("int")
    return texts.withColumns({"n": n, "_lo": lowest, "_hi": highest, "_c": c})


def _roles(numbered: DataFrame) -> DataFrame:
    """Texts once for each difference ``d`` in length (the partner's less the own) that a partner within reach may
    have, with the distance ``family`` that the two lengths allow. Differences that no text of the kind has are left out."""
    # A written table of short texts is one task or a few, and texts give several roles each and many keys a role: they are
    # dealt out before either.
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartition(parts, "_id")
    # Pairs of two long texts are left to the cells.
    either = F.struct((F.col("_hi") > _WIDEST).alias("long"), "n")
    lengths = numbered.groupBy("kind", "threshold").agg(F.collect_set(either).alias("_all"))
    short = F.transform(F.filter("_all", lambda of: ~of.long), lambda of: of.n)
    lengths = cut(lengths.select("kind", "threshold", short.alias("_short"), F.col("_all.n").alias("_any")), "lengths")
    most = F.least(F.col("_hi"), F.lit(_WIDEST))
    total = 2 * F.col("n") + F.col("d")
    given = ["_id", "kind", "threshold", "text", "asks", "n"]
    roles = (
        dealt.filter((F.col("_hi") >= 1) & (F.col("_lo") <= _WIDEST))
        .join(lengths, ["kind", "threshold"])
        .select(*given, F.when(F.col("_hi") > _WIDEST, F.col("_short")).otherwise(F.col("_any")).alias("_lengths"), F.explode(F.sequence(-most, most)).alias("d"))
        .filter(F.array_contains("_lengths", F.col("n") + F.col("d")))
    )
    roles = roles.select(*given, "d", max_distance(total, F.col("threshold")).alias("family"))
    roles = roles.filter((F.col("family") >= F.greatest(F.abs("d"), F.lit(1))) & (F.col("family") <= _WIDEST))
    # What is computed behind this shuffle would be computed once per key.
    roles = roles.withColumn("_plain", F.regexp_replace(F.lower("text"), "[^a-z0-9_ ]", ""))
    return roles.repartition(parts, "_id", "d")


def _role_keys(roles: DataFrame) -> DataFrame:
    """(_id, asks, key): the keys of every text in a role. Kind, threshold and both lengths go into the key, so that it is one
    number to sort and join by, and the text stays behind."""
    meet = [F.col(c) for c in ("kind", "threshold", "family")] + [F.abs("d"), F.least(F.col("n"), F.col("n") + F.col("d"))]
    given = ["_id", "asks"]
    # The longer text loses (family + |d|) / 2 symbols: at most one.
    one = roles.filter(F.col("family") + F.abs("d") <= 2)
    itself = one.filter("d > 0").select(*given, F.xxhash64(*meet, "text").alias("key"))
    place = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")
    # Of a run of one symbol it makes no difference which is lost.
    lost = one.filter("d <= 0").select("*", place).filter("_i = 1 or substr(text, _i, 1) <> substr(text, _i - 1, 1)")
    lost = lost.select(*given, F.xxhash64(*meet, F.expr("concat(substr(text, 1, _i - 1), substr(text, _i + 1))")).alias("key"))
    chosen = (
        roles.filter(F.col("family") + F.abs("d") > 2)
        .join(F.broadcast(_choice_table(roles.sparkSession)), "family")
        .select(*given, F.xxhash64(*meet, "choice", F.expr("translate(_plain, removed, '')")).alias("key"))
    )
    return lost.unionByName(itself).unionByName(chosen)


def _long_pairs(ranged: DataFrame, above: int = _WIDEST, with_texts: bool = True) -> DataFrame:
    """All matches (kind, a, b, uses_a, uses_b, score) at a distance that may be above ``above``, each once, among the texts
    that have partners at one above ``_WIDEST``.

    The texts of a kind are dealt into parts, and every two parts are one cell. A task holds a cell of at most some
    2 x ``PART`` texts, and gives its matches in pieces.
    """
    long = cut(ranged.filter(F.col("_hi") > _WIDEST).select(*_COLUMNS), "long_texts")
    sizes = long.groupBy("kind", "threshold").agg(F.count("*").alias("_size"))
    # Small parts as long as they are few, so that there is work for many tasks.
    number = F.least(F.ceil(F.col("_size") / (PART / 16)), F.greatest(F.lit(32), F.ceil(F.col("_size") / PART)))
    sizes = cut(sizes.select("kind", "threshold", number.cast("int").alias("_parts")), "sizes")
    dealt = long.join(sizes, ["kind", "threshold"]).withColumn("_part", F.pmod(F.xxhash64("text"), F.col("_parts")).cast("int"))
    cells = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cells = cells.select(*_COLUMNS, "_part", F.least("_part", "_other").alias("_lo_part"), F.greatest("_part", "_other").alias("_hi_part"))
    cell = ["kind", "threshold", "_lo_part", "_hi_part"]
    # A cell is few bytes and much work: a task has one or a few of them, or as many tasks as asked for have many.
    many = sizes.agg(F.sum(F.col("_parts").cast("double") * (F.col("_parts") + 1) / 2)).first()[0] or 0.0
    tasks = max(int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(many, TASKS)))
    cells = cells.repartition(tasks, *cell)
    uses = ranged.schema["uses"].dataType
    given = [("kind", T.StringType()), *([("a", T.StringType()), ("b", T.StringType())] if with_texts else [])]
    given += [("uses_a", uses), ("uses_b", uses), ("score", T.IntegerType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in given])
    return cells.groupBy(*cell).applyInArrow(matches_of_cell(above, with_texts), schema)


def _met(x: DataFrame, y: DataFrame, once: Column) -> DataFrame:
    """(_i, _j) of texts whose keys are equal and that meet the condition ``once``. One of the two asks."""
    x, y = x.alias("x"), y.alias("y")
    met = x.join(y, F.col("x.key") == F.col("y.key")).filter(once & (F.col("x.asks") | F.col("y.asks")))
    return met.select(F.least("x._id", "y._id").alias("_i"), F.greatest("x._id", "y._id").alias("_j"))


def _short_pairs(ranged: DataFrame) -> DataFrame:
    """Pairs at a distance of up to ``_WIDEST`` that share a key, each once, in order; ``_k`` is the most that the texts may differ by.

    Texts of one length meet among themselves: both sides differ in nothing but their alias, so they share
    one shuffle. Texts of two lengths meet as the shorter and the longer one. Texts have tens of keys, so they meet by
    a number that is written down with them, and pairs get their texts when they are found.
    """
    numbered = cut(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    roles = _roles(numbered)
    even = _role_keys(roles.filter("d = 0"))
    shorter, longer = _role_keys(roles.filter("d > 0")), _role_keys(roles.filter("d < 0"))
    met = _met(even, even, F.col("x._id") < F.col("y._id")).unionByName(_met(shorter, longer, F.col("x._id") != F.col("y._id")))
    x, y = numbered.select("_id", *_COLUMNS).alias("x"), numbered.select("_id", *_COLUMNS).alias("y")
    # Kinds that share a key by chance are told apart here.
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("kind", "threshold")]
    pairs = met.distinct().join(x, F.col("_i") == F.col("x._id")).join(y, [F.col("_j") == F.col("y._id"), *same])
    up = F.col("x.text") < F.col("y.text")
    sides = [F.when(up, F.col(f"{s}.{c}")).otherwise(F.col(f"{o}.{c}")).alias(n) for s, o, c, n in _ORDERED]
    k = max_distance(F.col("x.n") + F.col("y.n"), F.col("x.threshold"))
    return pairs.select("x.kind", "x.threshold", *sides, k.alias("_k")).filter(F.col("_k") <= _WIDEST)


def _few_pairs(ranged: DataFrame) -> DataFrame:
    """Pairs like those of ``_short_pairs`` of kinds of up to ``FEW`` texts: they meet on their kind."""
    x, y = ranged.select(*_COLUMNS).alias("x"), ranged.select(*_COLUMNS).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("kind", "threshold")]
    k = max_distance(F.col("x.n") + F.col("y.n"), F.col("x.threshold"))
    fits = (F.abs(F.col("x.n") - F.col("y.n")) <= k) & (F.col("x.text") < F.col("y.text")) & (F.col("x.asks") | F.col("y.asks"))
    met = x.join(y, [*same, fits])
    return met.select("x.kind", "x.threshold", *[F.col(f"{s}.{c}").alias(n) for s, c, n in _PAIR], k.alias("_k"))


def candidate_pairs(texts: DataFrame) -> DataFrame | None:
    """Distinct candidate pairs (kind, threshold, a, b, uses_a, uses_b), ``a < b``, but for those of two long texts in a kind of
    more than ``FEW``; none where there are no others. ``texts`` have their range of distances.

    The bounded edit distance is never above the number of insertions and deletions, so it loses nothing.
    """
    parts = []
    if "texts_of_kind" in texts.columns:
        parts.append(_few_pairs(texts.filter(F.col("texts_of_kind") <= FEW)))
        texts = texts.filter(F.col("texts_of_kind") > FEW)
    if not texts.filter(F.col("_hi") <= _WIDEST).isEmpty():
        parts.append(_short_pairs(texts))
    near = F.expr("levenshtein(a, b, greatest(_k, 0)) <> -1")
    return reduce(DataFrame.unionByName, [p.filter(near).drop("_k") for p in parts]) if parts else None


def similar_pairs(texts: DataFrame, with_texts: bool = True) -> DataFrame:
    """(kind, a, b, uses_a, uses_b, score) for all pairs ``a < b`` of one kind that
    reach their threshold; (kind, uses_a, uses_b, score) if not ``with_texts``.
    Pairs of an empty and another text score 0 and never occur.

    ``texts`` holds distinct (kind, threshold, text), optionally with the number
    of ``uses`` of each (or anything else that pairs are to be given) and whether it ``asks``: pairs of texts that
    both don't are left out. It should be a written table. Texts of different kinds never meet, so a
    kind may be as narrow as wanted; where ``texts_of_kind`` says how many a kind has, small
    kinds need no keys.

    The kernel counts as non-deterministic so that the optimizer does not move
    the filter on the score below it and run it once more there.
    """
    given = {"uses": F.lit(1).cast("bigint"), "asks": F.lit(True)}
    ranged = _ranged(texts.withColumns({c: v for c, v in given.items() if c not in texts.columns}))
    columns = ["kind", *(["a", "b"] if with_texts else []), "uses_a", "uses_b", "score"]
    found = []
    pairs = candidate_pairs(ranged)
    if pairs is not None:
        # Candidates are few bytes and much work: dealt out by bytes they would be a few uneven tasks.
        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = pairs.repartition(parts, "a", "b").withColumn("lcs", lcs_length(F.col("a"), F.col("b")))
        scored = pairs.withColumn("score", ratio(F.col("a"), F.col("b"), F.col("lcs")))
        found.append(scored.filter(F.col("score") >= F.col("threshold")).select(*columns))
    long = ranged.filter(F.col("_hi") > _WIDEST)
    if "texts_of_kind" in long.columns:
        long = long.filter(F.col("texts_of_kind") > FEW)
    if not found or not long.isEmpty():
        found.append(_long_pairs(long, 0, with_texts).select(*columns))
    return reduce(DataFrame.unionByName, found)
