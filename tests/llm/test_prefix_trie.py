"""The conversation trie against a dictionary of all beginnings."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from recordloom.llm import prefix_trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
# Names that the operator uses for itself.
SCHEMA = "conv_id bigint, turn bigint, role string, text string, one int, two string, k int, place int, n int, conv string, size int"


def _paths(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    return out


def _naive(rows):
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, path in sorted(_paths(rows).items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        up = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), up, len(convs), len(kids[p]), sum(not kids[q] for q in below), saved, digest))
    return sorted(out, key=str)


def _run(spark, rows, parts=4, **limits):
    frame = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, "c", 5) for r in rows], SCHEMA).repartition(parts)
    found = prefix_trie.trie(*prefix_trie.grafted(prefix_trie.numbered(frame)), **limits)
    return sorted((tuple(r[c] for c in NAMES) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 60), 100, 101, 103, 207, 208, 209]:  # some conversations have no base
        n = rng.choice([1, 1, 2, 3, 5, 9, 14])
        for k in range(n):
            turn = None if k == 0 and c % 7 == 0 else k
            out.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a", "bé", None, "", "long text " * 3]) if k > 2 else "hi"))
    out += [(60 + c, k, "user", f"same {k}") for c in range(40) for k in range(12)]  # one conversation many times
    out += [(300 + c, k, "user", "hot" if k < 6 else f"{c} {k}") for c in range(30) for k in range(9)]  # one long beginning
    out += [(5, 2, "user", "twice"), (5, 2, "user", "twice"), (5, 2, "bot", "tie"), (None, 0, "user", "nobody"), (None, None, None, None)]
    out += [(-7, 0, "user", "below zero"), (-5, 0, "user", "below zero"), (-5, 1, "user", "again")]
    return out


@pytest.mark.parametrize("limits", [{}, {"stretch": 4, "room": 3}, {"stretch": 1, "room": 1}])
def test_all_nodes(spark, rows, limits):
    assert _run(spark, rows, **limits) == _naive(rows)


def test_one_long_conversation_is_numbered_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_BLOCK", 16)
    rows = [(8, k, "user", f"t{k % 3}") for k in range(400)] + [(c, k, "user", f"t{k % 3}") for c in (5, 9, 11) for k in range(37)]
    assert _run(spark, rows, 8, stretch=32, room=4) == _naive(rows)


def test_empty_and_lone_rows(spark):
    assert _run(spark, [(None, 0, "user", "x")]) == []
    # h of 1 is more than its one turn, and it has no base: a conversation without turns.
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4)]
    assert _run(spark, rows) == _naive(rows)


def test_digests_in_pieces(spark):
    rows = [(5 * c, 0, "user", "x") for c in range(5000)]
    found = _run(spark, rows)
    assert {r[-1] for r in found} == {r[-1] for r in _naive(rows)}
