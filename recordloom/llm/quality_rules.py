"""Quality rules: how far a text's histograms diverge from those of a language, in built-in expressions only.

Two histograms of a text, over character classes and over common words, are compared with references for every
language by the Jensen-Shannon distance (the root of the divergence to base 2: 0 for equal, 1 for disjoint). The
nearest language counts, whichever ``lang`` says. Short texts have ragged histograms, so each test needs a minimum of
words; below it the test holds. Base rules on length, symbols and repetition come first.

Everything is one projection over the scan: no shuffle, no Python. Sub-results that several parts need are bound by a
one-element ``transform``, so that each is computed once a row. Equal 5-word windows are found by 64-bit hashes within
one text, sorted with their positions; so a text of any length takes n log n steps.

Null, empty and blank texts have no words and fail the base rules. Rows are judged one by one: a repeated row is
judged twice alike, and columns beyond id and text play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[ \t\n\x0B\f\r]+"
#: What is taken off the end of a word before it is looked up.
END_MARKS = ".,;:!?"

# Shares of lower-case, upper-case, white space, digits, symbols, marks and other characters in prose.
CLASS_SHARES = {
    "en": [0.790, 0.015, 0.167, 0.002, 0.000, 0.025, 0.001],
    "de": [0.765, 0.020, 0.155, 0.002, 0.000, 0.023, 0.035],
    "fr": [0.730, 0.012, 0.167, 0.002, 0.000, 0.025, 0.064],
    "es": [0.738, 0.012, 0.163, 0.002, 0.000, 0.024, 0.061],
}
# The most common words, most common first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "un", "las", "por"],
}
LANGUAGES = list(CLASS_SHARES)
#: The r-th common word makes up FIRST * r ** -SLOPE of all words; what is left belongs to all others.
FIRST, SLOPE = 0.061, 0.8
#: The words that a text needs for a test to apply. Chance distances shrink as a text gets longer: by the number of
#: words for the classes, by its root for the words; so do the largest distances that pass.
CLASS_WORDS, CLASS_LIMIT, CLASS_CHANCE = 20, 0.18, 3.0
WORD_WORDS, WORD_LIMIT, WORD_CHANCE = 40, 0.16, 0.95


def word_shares(language: str) -> list[float]:
    some = [FIRST * r**-SLOPE for r in range(1, len(COMMON_WORDS[language]) + 1)]
    return [*some, 1.0 - sum(some)]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def divergence(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts out of ``total`` from a reference."""
    size = sum(reference)

    def term(n: Column, q: Column) -> Column:
        p = n / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)

    shares = F.array(*[F.lit(q / size) for q in reference])
    both = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(both, F.lit(0.0)) / F.lit(2 * math.log(2.0)))


def words_in_repeats(words: Column, window: int = 5) -> Column:
    """Words of a text's ``window``-word runs that the text has twice or more."""

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1), p + window) - p))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(runs: Column) -> Column:
        """Places of the runs whose neighbour among the sorted ones is equal."""
        twin = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        same = F.filter(runs, lambda x, k: twin(x, F.get(runs, k + 1)) | twin(x, F.get(runs, k - 1)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - window),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]),
        )
        sort = lambda r: F.sort_array(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = lambda r: F.when(
            F.size(F.array_distinct(r)) < F.size(r), bound(sort(r), lambda s: bound(repeated(s), covered))
        ).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(hashes) > window, bound(runs, some)).otherwise(F.lit(0).cast("long"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), count)


def judged(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Id, base figures, distances and verdict of every row."""
    rest = docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # Take the classes out of the text one after another; what is left gets short at once.
    steps = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("gap", WORD_GAP), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("mark", "[.,;:!?'\"()-]+")]
    known, last = [], "t"
    for name, drop in steps:
        rest = rest.withColumn(f"_{name}", F.regexp_replace(last, drop, ""))
        known.append((name, F.length(last) - F.length(f"_{name}")))
        last = f"_{name}"
    rest = rest.select(id_col, "t", *[c.cast("double").alias(n) for n, c in known], F.length(last).cast("double").alias("other"), F.length("t").alias("n_chars"))

    words = F.array_remove(F.split("t", WORD_GAP), "")
    every = sorted({w for some in COMMON_WORDS.values() for w in some})

    def common(w: Column) -> Column:
        found = F.filter(F.transform(w, lambda x: F.lower(F.rtrim(x, F.lit(END_MARKS)))), lambda x: x.isin(every))
        return bound(found, lambda f: F.array(*[F.size(f) - F.size(F.array_remove(f, r)) for r in every]))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    of_words = bound(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), words_in_repeats(w).alias("n_repeat_words"), common(w).alias("common")),
    )
    rest = rest.withColumn("w", of_words).withColumn("n_dup_lines", bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rest = rest.select(
        id_col, F.col("w.n_words").alias("n_words"), (F.col("n_chars") - F.col("gap")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"), "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"),
        "n_chars", "w.common", F.array("lower", "upper", "gap", "digit", "symbol", "mark", "other").alias("classes"),
    )

    def of_language(name: str) -> Column:
        own = [F.get("common", F.lit(every.index(w))) for w in COMMON_WORDS[name]]
        other = F.col("n_words") - sum(own[1:], own[0])
        return divergence(F.array(*[c.cast("double") for c in own], other.cast("double")), F.col("n_words"), word_shares(name))

    has = F.col("n_words") > 0
    rest = rest.select(
        "*",
        F.when(has, F.round(F.least(*[divergence(F.col("classes"), F.col("n_chars"), CLASS_SHARES[x]) for x in LANGUAGES]), 9)).alias("class_distance"),
        F.when(has, F.round(F.least(*[of_language(x) for x in LANGUAGES]), 9)).alias("word_distance"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    passed = ~failed
    passed &= (F.col("n_words") < CLASS_WORDS) | (F.col("class_distance") <= F.lit(CLASS_LIMIT) + F.lit(CLASS_CHANCE) / F.col("n_words"))
    passed &= (F.col("n_words") < WORD_WORDS) | (F.col("word_distance") <= F.lit(WORD_LIMIT) + F.lit(WORD_CHANCE) / F.sqrt("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rest.select(id_col, *base, failed.alias("base_failed"), passed.alias("kept"), "class_distance", "word_distance")
