"""Small value helpers: currency, dates, truncation, defaults, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import is_blank, strip

# --- Fixed values: the date patterns tried in this order. ---
DATE_PATTERNS = [
    "yyyy-M-d",
    "M/d/yyyy",
    "M-d-yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "MMMM d, yyyy",
    "MMM d, yyyy",
]
# --- End of fixed values. ---

_NUMBER = (
    r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|(?i)^([+-]?(inf|infinity)|nan)$"
)


def parse_currency(c: Column) -> Column:
    """``$1,234.50`` to a double; anything that is no number gives null."""
    plain = strip(F.regexp_replace(strip(c), "[$,]", ""))
    number = F.when(plain.rlike(_NUMBER), F.regexp_replace(plain, "_", ""))
    return number.try_cast("double")


def parse_date(c: Column, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    """First pattern that fits, as ``yyyy-MM-dd`` text; null when none does."""
    text = strip(c)
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in patterns]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def truncate(c: Column, max_length: int = 100, suffix: str = "...") -> Column:
    keep = max_length - len(suffix)
    head = F.substring(c, 1, keep) if keep >= 0 else F.substring(c, 1, F.greatest(F.length(c) + keep, F.lit(0)))
    return F.when(F.length(c) > max_length, F.concat(head, F.lit(suffix))).otherwise(c)


def value_or(c: Column, default: Column) -> Column:
    """The value, or the default where it is null or blank."""
    return F.when(is_blank(c), default).otherwise(c)


def value_text(c: Column, dtype: T.DataType) -> Column:
    """A value as the text that is hashed: nothing for null, zero and false; a
    number in plain decimals, one of a floating type with at least one place."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("true"))
    if not isinstance(dtype, T.NumericType):
        return c.cast("string")
    text = c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        places = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "(?<=[0-9])0+$", "")
        plain = F.regexp_replace(places, r"\.$", ".0")
        # Without an exponent the text is plain already; very large and very small numbers keep theirs.
        exact = text.contains("E") & (F.abs(c) < 1e16) & (F.abs(c) >= 1e-4)
        text = F.when(exact, plain).otherwise(text)
    return F.when(c != 0, text)


def record_hash(*cols: Column, types: list[T.DataType] | None = None) -> Column:
    """md5 over the lower-cased, trimmed values joined by ``|``; null, zero and
    false as empty. Columns count as text unless ``types`` are given."""
    types = types or [T.StringType()] * len(cols)
    texts = [value_text(c, t) for c, t in zip(cols, types)]
    return F.md5(F.concat_ws("|", *[F.coalesce(F.lower(strip(t)), F.lit("")) for t in texts]))
