"""Token-sort similarity: normal form, bounds and the scoring kernel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import strip


def processed(c: Column) -> Column:
    """ASCII only, non-word characters to blanks, lower case, trimmed."""
    ascii_only = F.regexp_replace(c, r"[^\x00-\x7f]", "")
    return F.trim(F.lower(F.regexp_replace(ascii_only, r"\W", " ")))


def token_sorted(c: Column) -> Column:
    """The processed words in ascending order, joined by one blank."""
    return F.array_join(F.array_sort(F.split(processed(c), " +")), " ")


def normal_form(c: Column, matcher: str = "token_sort_ratio") -> Column:
    """The text that the matcher compares."""
    if matcher == "token_sort_ratio":
        return token_sorted(F.upper(strip(c)))
    if matcher == "ratio":
        return F.upper(strip(c))
    raise ValueError(f"unsupported matcher {matcher!r}: use 'token_sort_ratio' or 'ratio'")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts.

    Bit-parallel over whole Python integers, in Arrow batches. The helper is
    nested so that it travels with the task.
    """

    def length(x: str, y: str) -> int:
        at: dict[str, int] = {}
        for i, ch in enumerate(x):
            at[ch] = at.get(ch, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for ch in y:
            hit = row & at.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    def lengths(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([length(x, y) for x, y in zip(xs, ys)], dtype="int32")

    return F.pandas_udf(lengths, T.IntegerType()).asNondeterministic()(a, b)


def ratio(a: Column, b: Column, lcs: Column) -> Column:
    """Score 0 to 100 from the subsequence length, rounded half to even."""
    total = F.length(a) + F.length(b)
    score = F.rint(F.lit(100.0) * ((F.lit(2.0) * lcs) / total)).cast("int")
    return F.when(a == b, F.lit(100)).when((a == "") | (b == ""), F.lit(0)).otherwise(score)


def similarity(a: Column, b: Column) -> Column:
    """Score of two normal forms; null when either is null. Equal forms score without the
    kernel, which is given empty texts for them, as ``when`` doesn't keep it from running."""
    blank = F.lit("")
    x, y = (F.when(a == b, blank).otherwise(F.coalesce(c, blank)) for c in (a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).otherwise(ratio(a, b, lcs_length(x, y)))


def max_distance(total: Column, threshold: Column) -> Column:
    """Most insertions and deletions that two texts of this total length may
    differ by and still reach the threshold (parity makes it exact).

    The score is rounded, so ``threshold - 0.5`` is the real bound; it is taken
    a hair wider so that no rounding of doubles can lose a pair.
    """
    bound = F.floor(total * ((F.lit(100.5) - threshold) / 100.0 + F.lit(1e-9))).cast("int")
    return bound - F.pmod(bound + total, F.lit(2))
