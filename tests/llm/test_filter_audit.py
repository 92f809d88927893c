"""The filter audit against sending every document through every order."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from recordloom.llm import filter_audit as audit

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, part string, mask string, one int, n string"


def _naive(rows, labels):
    """rows: (id, text, source); labels: (id, quality, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = {k: {i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1)}
    out = Counter()
    parts = {s or "" for _, _, s in rows}
    for i, t, s in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, x in enumerate(order, 1):
                at = s or "", order, k
                out[at, "removed"] += fails[x] and not gone
                out[at, "good_lost"] += fails[x] and not gone and i in marks[0]
                out[at, "toxic_lost"] += fails[x] and not gone and i in marks[1]
                out[at, "redundant"] += fails[x] and gone
                out[at, "unique_fails"] += fails[x] and sum(fails.values()) == 1
                gone = gone or fails[x]
                out[at, "kept"] += not gone
    for p in parts:
        for x in "ABCDE":
            at = [(p, "".join(o), o.index(x) + 1) for o in permutations("ABCDE")]
            total = sum(out[a, "removed"] for a in at)
            for a in at:
                out[a, "shapley"] = total
    return {k: v for k, v in out.items() if v}, parts


def _found(rows):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {((r["part"], r["filter_order"], r["step"]), c): r[c] for r in rows for c in names if r[c]}


def _run(spark, rows, labels, parts=3):
    docs = spark.createDataFrame([(i, t, "en", s, 0, 1, "x", "m", 2, "n") for i, t, s in rows], SCHEMA).repartition(parts)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, part string, id int")
    return audit.audit(audit.mask_counts(audit.document_masks(docs), known)).collect()


def test_all_orders_over_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(220))
    rows = [(1, long, "a"), (5, long, "a"), (5, long, "b"), (1, long, "a"), (None, long, "b"), (7, long, None)]
    rows += [(2, None, "a"), (3, "", "b"), (None, None, None), (4, "a b c", ""), (6, "A b", "a"), (8, "ÄÖ #", "c"), (9, "x " * 300, "c")]
    rows += [(10, long + " $ " + "B" * 90, "a"), (11, "é" * 98 + "AA", "b"), (12, "é" * 97 + "AAA", "b"), (13, "a\x0bb\x1cc", "b"), (14, "x " * 300, "a")]
    labels = [(1, 1, 0, "p", 1), (5, 0, 1, "p", 1), (5, 1, 0, "p", 1), (8, None, 1, "p", 1), (None, 1, 1, "p", 1), (9, 1, None, "p", 1), (99, 1, 1, "p", 1)]
    found = _run(spark, rows, labels)
    want, parts = _naive(rows, [x[:3] for x in labels])
    assert _found(found) == want
    assert len(found) == 600 * len(parts)


def test_hot_text_and_one_source(spark):
    rows = [(k % 150, "same #", "s") for k in range(300)] + [(k, f"t{k}", "s") for k in range(300, 340)]
    found = _run(spark, rows, [(3, 1, 1, "p", 0)], 7)
    assert _found(found) == _naive(rows, [(3, 1, 1)])[0]


def test_empty_tables(spark):
    assert _run(spark, [], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_intervals_are_the_removing_orders(n):
    orders = list(permutations(range(n)))
    assert [audit.lehmer_rank(o, n) for o in orders] == list(range(len(orders)))
    covered = Counter((m, s, r) for m, s, a, b in audit.removal_intervals(n) for r in range(a, b))
    assert set(covered.values()) <= {1}
    want = {(m, next(k for k, x in enumerate(o, 1) if m >> x & 1), r) for m in range(1, 1 << n) for r, o in enumerate(orders)}
    assert set(covered) == want


def test_long_texts_are_counted_as_hashes(monkeypatch):
    texts = [b"a b a c\x0b\x0cd  a", b"", b" ", "Ünï 漢字 漢字".encode()]
    whole = [audit.own_mask(t) for t in texts], [audit._words(t) for t in texts]
    monkeypatch.setattr(audit, "_LONG", 0)
    assert ([audit.own_mask(t) for t in texts], [audit._words(t) for t in texts]) == whole
