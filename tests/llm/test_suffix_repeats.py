"""Repeated byte strings against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import suffix_repeats as repeats

SCHEMA = "doc_id bigint, text string, row string, id int, key string, kind int, body string, print string"


def _brute_lpf(data: bytes, length: int) -> list[int]:
    def shared(i, j):
        n = 0
        while j + n < len(data) and n < length and data[i + n] == data[j + n]:
            n += 1
        return n

    return [max((shared(i, j) for i in range(j)), default=0) for j in range(len(data))]


@pytest.mark.parametrize("length", [1, 2, 5, 7, 8, 20, 22, 64, 400])
def test_longest_previous_factors(length):
    rng = random.Random(length)
    for data in [b"", b"a", b"aaaaaaaaaa", b"\x00\x00\x00a\x00\x00", b"abcabcabcab", bytes(rng.choice(b"ab") for _ in range(90)), bytes(rng.choice(b"abcd\x00\xff") for _ in range(200)) * 2]:
        assert repeats.lpf(data, length).tolist() == _brute_lpf(data, length), data


def test_sources_are_where_it_says():
    rng = random.Random(0)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    at = np.arange(0, 380)
    sa, lcp = repeats.suffix_order(repeats.ranked(data, 6), at, 6)
    shared, source = repeats.previous_factors(sa, lcp, 6)
    for i, n, j in zip(sa.tolist(), shared.tolist(), source.tolist()):
        earlier = [k for k in range(i) if bytes(data[k : k + 6]) == bytes(data[i : i + 6])]
        assert (n == 6) == bool(earlier) and (not earlier or j in earlier)


def _naive(rows, length, keep):
    """rows: (id, text). Result by (id, text): bytes kept, spans."""
    starts = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for r, t in enumerate(texts):
        for o in range(len(t) - length + 1):
            starts[t[o : o + length]].append((r, o))
    out = []
    for r, ((i, _), t) in enumerate(zip(rows, texts)):
        gone = [False] * len(t)
        for o in range(len(t) - length + 1):
            places = starts[t[o : o + length]]
            # Rows that share id and text are one place.
            if len(places) > 1 and (keep == "none" or any((rows[q][0], p) < (i, o) for q, p in places)):
                gone[o : o + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def _run(spark, rows, length, keep, limits=repeats.Limits(), parts=4):
    docs = spark.createDataFrame([(i, t, "r", 1, "k", 2, "b", "p") for i, t in rows], SCHEMA).repartition(parts)
    found = repeats.without_repeats(docs, length, keep, limits=limits).select("row.doc_id", "row.key", "n_bytes", "spans", "kept").collect()
    out = []
    for r in found:
        assert r["key"] == "k" and r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        out.append((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)

    def prose(n, letters="abcdefgh ü漢"):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, notice = prose(90), prose(60)
    texts = [prose(rng.randint(0, 300)) for _ in range(30)]
    texts += [prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)) for _ in range(25)]  # a hot passage
    texts += [a[:40] + "!" + a[45:] for a in texts[:10]] + texts[3:6] + [notice * 3, notice[:50], notice[10:] + "x"]
    texts += ["", None, "x" * 700, "ab" * 200, "x" * 39, "x" * 40, "é" * 30, prose(2000) + passage[20:80] + prose(900)]
    return list(enumerate(texts)) + [(200, texts[31]), (201, texts[31]), (202, texts[31])]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limits", [{}, {"many": 3, "many_here": 2, "stretches": 20, "windows": 50, "laid": 100}, {"many_here": 1, "piece": 64, "batch": 1}, {"many": 1}])
def test_all_windows(spark, rows, keep, limits):
    assert _run(spark, rows, 40, keep, repeats.Limits(**limits)) == _naive(rows, 40, keep)


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = "the same passage of text, " * 3, "another passage " * 4
    rows = [(1, a), (1, b), (1, a), (2, "x" + b), (None, a), (None, b + "y"), (None, None), (3, None)]
    assert _run(spark, rows, 20, "none") == _naive(rows, 20, "none")


def test_the_first_copy_stays(spark):
    passage = "a passage that two documents share word for word"
    found = _run(spark, [(5, "first. " + passage), (3, passage + " second."), (4, passage[:20])], 30, "first")
    assert [(r[0], r[2]) for r in found] == [(3, 0), (4, 0), (5, len(passage))]


def test_empty_tables_and_wrong_arguments(spark):
    assert _run(spark, [], 40, "none") == []
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for bad in ({"length": 0}, {"keep": "last"}):
        with pytest.raises(ValueError):
            repeats.without_repeats(docs, **bad)


def test_columns_of_other_types(spark):
    docs = spark.range(3).select(F.col("id").cast("int").alias("doc_id"), F.lit("n" * 50).alias("text"), F.array(F.lit(1)).alias("more"))
    found = repeats.without_repeats(docs, 40, "none").select("row.more", "kept").collect()
    assert [(r["more"], bytes(r["kept"])) for r in found] == [([1], b"")] * 3
