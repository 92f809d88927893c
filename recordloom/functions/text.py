"""Text normalisation as native column expressions (no Python in the tasks)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.config import (
    COMPANY_MARKERS,
    ENTITY_SUFFIXES,
    STATE_CODES,
    STREET_ABBREVIATIONS,
)

# Unicode white space plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{SPACE}+|{SPACE}+$"
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, _EDGES, "")


def collapse(c: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null itself."""
    return F.coalesce(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def title(c: Column) -> Column:
    """Upper-case the first letter of each letter run, lower-case the rest.

    ``initcap`` starts words at blanks only, so it serves plain words; text with
    digits, quotes, hyphens or letters beyond ASCII is cut into letter runs.
    """
    runs = F.regexp_extract_all(c, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    by_run = F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(r.substr(1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))),
        "",
    )
    return F.when(c.rlike("^[A-Za-z ]*$"), F.initcap(c)).otherwise(by_run)


def flip_last_first(c: Column) -> Column:
    """``LAST, FIRST`` becomes ``FIRST LAST`` unless a company marker occurs."""
    company = F.upper(c).rlike("|".join(COMPANY_MARKERS))
    at = F.instr(c, ",")
    last = strip(F.substring_index(c, ",", 1))
    first = strip(F.substring(c, at + F.lit(1), F.length(c)))
    return F.when((at > 0) & ~company, F.concat_ws(" ", first, last)).otherwise(c)


def _suffix_forms(suffix: str) -> list[str]:
    dotted = re.escape("".join(ch + "." for ch in suffix))
    return [rf"(?U)\b{form}\b" for form in (suffix, dotted, " ".join(suffix))]


def normalize_suffix(c: Column) -> Column:
    """Write entity suffixes in one form.

    The last suffix of the list that occurs decides, and it is replaced in the
    upper-cased input, so earlier replacements are not kept.
    """
    up = F.upper(c)
    forms = [(s, p) for s in reversed(ENTITY_SUFFIXES) for p in _suffix_forms(s)]
    any_form = "|".join(p.removeprefix("(?U)") for _, p in forms)
    replaced = F.coalesce(*[F.when(up.rlike(p), F.regexp_replace(up, p, s)) for s, p in forms])
    return F.when(up.rlike(f"(?U){any_form}"), replaced).otherwise(c)


def title_keeping_acronyms(c: Column) -> Column:
    """Title case per word; suffixes and upper-case words up to 3 letters stay."""

    def word(w: Column) -> Column:
        is_upper = (w == F.upper(w)) & w.rlike(r"\p{Lu}")
        return (
            F.when(F.upper(w).isin(ENTITY_SUFFIXES), F.upper(w))
            .when((F.length(w) <= 3) & is_upper, w)
            .otherwise(title(w))
        )

    return F.array_join(F.transform(F.split(c, " "), word), " ")


def abbreviate_streets(c: Column) -> Column:
    for word, short in STREET_ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"(?U)\b{word}\b", short)
    return c


def state_code(c: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in STATE_CODES.items() for x in pair])
    return F.substring(F.coalesce(codes[c], c), 1, 2)


def zero_fill(c: Column, width: int) -> Column:
    """Left-pad with zeros; longer text stays whole (``lpad`` would cut it)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def zip_digits(c: Column) -> Column:
    """Digits and inner hyphens; null for null and empty text."""
    return F.when(c != "", F.regexp_replace(F.regexp_replace(c, r"[^\d\-]", ""), "^-+|-+$", ""))


def zip_form(c: Column) -> Column:
    """5 or 5-4 digits; more than two hyphen parts give null."""
    parts = F.split(c, "-")
    extended = F.concat_ws("-", zero_fill(parts[0], 5), F.rpad(F.substring(F.get(parts, F.lit(1)), 1, 4), 4, "0"))
    return (
        F.when(c.isNull(), F.lit(""))
        .when(F.size(parts) == 2, extended)
        .when(F.size(parts) > 2, F.lit(None).cast("string"))
        .when(F.length(c) == 9, F.concat_ws("-", F.substring(c, 1, 5), F.substring(c, 6, 4)))
        .when(F.length(c) <= 5, zero_fill(c, 5))
        .otherwise(F.substring(c, 1, 5))
    )


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# Each field is cleaned in steps. A step may use its input several times, so the
# steps become one projection each and nothing is computed twice per row.
STEPS = {
    "owner_name": [collapse, flip_last_first, normalize_suffix, collapse, title_keeping_acronyms, or_empty],
    "address": [collapse, F.upper, abbreviate_streets, or_empty],
    "city": [collapse, title, or_empty],
    "state": [strip, F.upper, state_code, or_empty],
    "zip_code": [zip_digits, zip_form],
}


def normalize_address(c: Column) -> Column:
    """All address steps in one expression; every step uses its input once."""
    for step in STEPS["address"]:
        c = step(c)
    return c


def match_key(c: Column) -> Column:
    """Upper-cased, trimmed text: the form in which keys are compared."""
    return F.upper(strip(c.cast("string")))
