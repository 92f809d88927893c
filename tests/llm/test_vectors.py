"""Near-duplicate vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from recordloom.llm import vectors


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, id int, v string").repartition(3)


def _brute(rows, least=0.95):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    links = {i: set() for i, *_ in rows if i is not None}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i].add(j)
    component = {}
    for i in sorted(links):
        if i not in component:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in component:
                    component[x] = i
                    stack += links[x]
    return {i: (len(x), component[i]) for i, x in links.items()}


@pytest.mark.parametrize("block", [4096, 40])
def test_near_duplicates(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        v = rng.normal(size=16)
        rows.append((len(rows), v, 0))
        for _ in range(int(rng.choice([0, 0, 1, 3, 30 if k < 3 else 0]))):
            rows.append((len(rows), v + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.25]), 0))
    rows = [(i, [float(x) for x in v], y, 7, "x") for i, v, y in rows]
    rows += [(900, None, 1, 7, "x"), (901, [], 1, 7, "x"), (902, [0.0] * 16, 1, 7, "x"), (903, [None] + [1.0] * 15, 1, 7, None), (904, [float("nan")] * 16, 1, 7, "x")]
    rows += [(905, [float("inf")] * 16, 1, 7, "x"), (906, [1.0, 2.0], 1, 7, "x"), (907, [2.0, 4.0], 1, 7, "x"), (908, rows[0][1], None, 7, "x"), (None, rows[0][1], 1, 7, "x")]
    got = vectors.near_duplicates(_table(spark, rows), per_centre=40, block=block).collect()
    want = _brute(rows)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None}
    assert len(got) == len(rows) and found.keys() == want.keys()
    assert all(found[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(n for n, _ in found.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert [r["kept"] for r in got if r["vec_id"] is None] == [True]


def test_empty_table(spark):
    assert vectors.near_duplicates(_table(spark, [])).count() == 0
    one = vectors.near_duplicates(_table(spark, [(4, [1.0, 0.0], 1, 1, "x")])).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in one] == [(4, 0, 4, True)]


def test_recall_is_audited(spark):
    frame = vectors.usable(_table(spark, [(20 * k, [1.0, 0.01 * k], 1, 1, "x") for k in range(5)]), "vec_id", "embedding")
    own = frame.selectExpr("id", "v", "1L weight")
    none = spark.createDataFrame([], "id bigint, links bigint")
    assert vectors.audited(own, none, 0.95) == 0.0
    assert vectors.audited(own, own.selectExpr("id", "4L links"), 0.95) == 1.0
