"""The similarity join and the grouping against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.functions.similarity import normal_form, similarity, token_sorted
from recordloom.operators import cells, dedup, groups, similar
from recordloom.operators.groups import greedy_groups
from recordloom.operators.similar import SYMBOLS, similar_pairs
from recordloom.sinks.snapshots import cut


def lcs(a, b):
    """Longest common subsequence by the plain table, one numpy row at a time."""
    bs = np.frombuffer(b.encode("latin-1"), dtype=np.uint8)
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a.encode("latin-1"):
        best = np.maximum(row[1:], row[:-1] + (bs == x))
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1])


def score(a, b):
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(100 * ((2 * lcs(a, b)) / (len(a) + len(b))))


def test_symbols_are_complete():
    assert sorted(SYMBOLS) == sorted("abcdefghijklmnopqrstuvwxyz0123456789 _")


def _mutations(rng, texts, n, alphabet):
    out = set(texts)
    for _ in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(1, max(1, len(t) // 8))):
            i = rng.randrange(len(t) + 1)
            if rng.random() < 0.5 and len(t) > 1:
                del t[min(i, len(t) - 1)]
            else:
                t.insert(i, rng.choice(alphabet))
        out.add("".join(t).strip())
    return sorted(x for x in out if x)


@pytest.mark.parametrize("threshold", [80, 90, 95])
def test_join_equals_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    alphabet = "abcdeimnorst 0123456789"
    bases = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (2, 5, 9, 12, 17, 19, 20, 25, 33, 46, 60, 90, 140)]
    bases += [f"{n} n chapel hill rd" for n in (1204, 1205, 1214, 99)]
    bases += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (200, 260, 420)] + ["ab" * 150, "a" * 250]
    texts = _mutations(rng, bases, 350, alphabet)
    df = spark.createDataFrame([("t", threshold, x) for x in texts], "kind string, threshold int, text string")
    got = {(r.a, r.b): r.score for r in similar_pairs(df).collect()}
    want = {}
    letters = {t: Counter(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            # No common subsequence is longer than the letters in common.
            if 200 * (letters[a] & letters[b]).total() < (threshold - 1) * (len(a) + len(b)):
                continue
            s = score(a, b)
            if s >= threshold:
                want[(a, b)] = s
    assert len(want) > 300
    assert got == want


def test_scores(spark):
    cases = {
        ("123 MAIN STREET", "123 MAIN ST"): 85,
        ("JOHN MICHAEL SMITH", "JOHN M SMITH"): 80,
        ("456 OAK AVE", "456 OAK AVENUE"): 88,
        ("100 MAIN ST", "101 MAIN ST"): 91,
        ("1204 CHAPEL HILL RD", "1205 CHAPEL HILL RD"): 95,
        ("202 CHAPEL HILL RD", "203 CHAPEL HILL RD"): 94,
        ("SMITH JOHN", "JOHN SMITH"): 100,
        ("###", "***"): 100,
        ("###", "A"): 0,
    }
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string")
    got = df.select("a", "b", similarity(normal_form(F.col("a")), normal_form(F.col("b"))).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in got} == cases
    row = df.limit(1).select(token_sorted(F.lit("Zoë, b-a  A.")).alias("t")).first()
    assert row.t == "a a b zo"
    with pytest.raises(ValueError):
        normal_form(F.lit("x"), "partial_ratio")


def _sequential(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, label = set(), {}
    for i in range(n):
        if i in seen:
            continue
        taken = {j for j in near[i] if j > i and j not in seen}
        if taken:
            seen |= taken | {i}
            label |= {j: i for j in taken}
    return label


def test_rounds_equal_sequential_pass(spark):
    rng = random.Random(5)
    edges, want = [], {}
    # Many random graphs side by side, plus a chain, in one edge table.
    for g in range(60):
        n, base = 12, g * 100
        some = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 18))}
        edges += [(base + a, base + b) for a, b in some]
        want |= {base + v: base + s for v, s in _sequential(n, some).items()}
    chain = [(i, i + 1) for i in range(9)]
    edges += [(10_000 + a, 10_000 + b) for a, b in chain]
    want |= {10_000 + v: 10_000 + s for v, s in _sequential(10, chain).items()}
    table = cut(spark.createDataFrame(edges, "lo bigint, hi bigint"), "test_edges")
    for room in (10_000, 12, 5, 0):  # one pass, components that fit, some that don't, rounds only
        assert {r.v: r.seed for r in greedy_groups(table, room).collect()} == want


def test_a_street_takes_few_writes(spark, monkeypatch):
    """1,000 houses, each like the next one, and names of vertices that are structs or texts."""
    writes = []
    monkeypatch.setattr(groups, "cut", lambda df, name: (writes.append(name), cut(df, name))[1])
    chain = [(i, i + 1) for i in range(999)]
    table = cut(spark.createDataFrame(chain, "lo bigint, hi bigint"), "street")
    want = {2 * i + 1: 2 * i for i in range(500)}
    assert {r.v: r.seed for r in greedy_groups(table).collect()} == want and len(writes) <= 4
    named = cut(table.select(*[F.struct(F.lit("s").alias("k"), F.col(c).alias("i")).alias(c) for c in ("lo", "hi")]), "street")
    assert {r.v.i: r.seed.i for r in greedy_groups(named).collect()} == want
    assert {r.v.i: r.seed.i for r in greedy_groups(named.limit(40), 5).collect()} == {v: s for v, s in want.items() if v <= 40}
    texts = table.select(*[F.format_string("%05d", c).alias(c) for c in ("lo", "hi")])
    assert {int(r.v): int(r.seed) for r in greedy_groups(cut(texts, "street")).collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 9), (3, 4), (4, 8), (3, 8), (5, 6)], "lo int, hi int")
    assert {(r.u, r.component) for r in groups.components(edges).collect()} == {(2, 1), (9, 1), (4, 3), (8, 3), (6, 5)}


@pytest.mark.parametrize("length", [60, 80, 140])
def test_long_names_of_common_words_seldom_meet(spark, length):
    """1,500 names without an address: what leaves the join is a small part of all pairs, and none that matches is lost."""
    rng = random.Random(length)
    common = "smith jones brown wilson family trust holdings properties land estate living revocable the of and limited john mary robert linda north durham church first oak".split()
    names = set()
    while len(names) < 1500:
        words = []
        while len(" ".join(words)) < length:
            words.append(rng.choice(common))
        names.add(" ".join(sorted(words))[: length + rng.randint(-2, 2)])
    names = sorted(names)
    names[::50] = [n[:20] + n[23:] + "x" for n in names[1::50]]
    names = sorted({n.strip() for n in names})
    texts = cut(spark.createDataFrame([("name", 90, n) for n in names], "kind string, threshold int, text string"), "names")
    ranged = similar._ranged(texts.withColumns({"uses": F.lit(1).cast("bigint"), "asks": F.lit(True)}))
    met = similar._long_pairs(ranged).distinct()
    assert met.count() < 0.05 * len(names) * (len(names) - 1) / 2
    found = {(r["a"], r["b"]) for r in similar_pairs(texts).collect()}
    near = [(a, b) for i, a in enumerate(names) for b in names[i + 1 : i + 30] if score(a, b) >= 90]
    assert len(found) >= 20 and set(near) <= found and all(score(a, b) >= 90 for a, b in found)


@pytest.mark.parametrize("part", [16, 8192])
def test_long_texts_meet_once_whatever_they_share(spark, monkeypatch, part):
    """Texts that all hold the same symbols: cells of any size give each pair once, and none that matches is lost."""
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(3)
    base = "smith jones family trust of north carolina revocable living holdings properties durham"
    texts = sorted(set(_mutations(rng, [base, base[:70] + " é", base + base], 150, "abcdeimnorst 0123456789é")))
    df = cut(spark.createDataFrame([("name", 90, t) for t in texts], "kind string, threshold int, text string"), "names")
    ranged = similar._ranged(df.withColumns({"uses": F.length("text").cast("bigint"), "asks": F.length("text") % 2 == 0}))
    met = [(r["a"], r["b"], r["uses_a"], r["uses_b"]) for r in similar._long_pairs(ranged).collect()]
    assert len(met) == len(set(met)) and all(a < b and (len(a), len(b)) == (x, y) for a, b, x, y in met)
    found = {(a, b) for a, b, _, _ in met}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            bound = int((len(a) + len(b)) * 0.105 + 1e-7)
            far = bound - (bound + len(a) + len(b)) % 2 > 12
            if far and not (len(a) % 2 and len(b) % 2) and score(a, b) >= 90:
                found.remove((a, b))
    assert all(score(a, b) < 90 for a, b in found)


def _model(rows, name_t=90, address_t=95):
    """The grouping of rows (idx, name, address) as one sequential pass."""

    def form(t):
        words = "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").upper() if c.isascii()).lower()
        return " ".join(sorted(words.split()))

    def same(x, y):
        if not (x[1] or "").strip() or not (y[1] or "").strip():
            return False
        ok = score(form(x[1]), form(y[1])) >= name_t
        if (x[2] or "").strip() and (y[2] or "").strip():
            return ok and score(form(x[2]), form(y[2])) >= address_t
        return ok

    seen, label = set(), {}
    for i, x in enumerate(rows):
        if x[0] in seen:
            continue
        group = [y for y in rows[i + 1 :] if y[0] not in seen and same(x, y)]
        if group:
            for y in [x, *group]:
                seen.add(y[0])
                label[y[0]] = x[0]
    return label


@pytest.mark.parametrize("partitions", ["3", "8"])
def test_fuzzy_groups_equal_model(spark, partitions):
    rng = random.Random(11)
    names = _mutations(rng, ["JOHN SMITH", "MARGARET WELLINGTON", "ACME HOLDINGS LLC"], 30, "ABEHLMNORST")
    places = _mutations(rng, ["1204 CHAPEL HILL RD", "77 MARTIN LUTHER KING BLVD"], 25, "0123456789AEIRT")
    rows = [
        (i, rng.choice([*names[:20], "JOHN SMITH", "JOHN SMITH", "", " ", None, "##"]), rng.choice([*places, "", None, "77 MARTIN LUTHER KING BLVD"]))
        for i in range(160)
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "rec_idx bigint, owner_name string, property_address string")
        got = dedup.find_duplicates(df.withColumn("parcel_id", F.lit("")))
        assert {r.rec_idx: r.duplicate_group for r in got.collect() if r.duplicate_group is not None} == _model(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ratio_matcher_and_order_of_any_type(spark):
    rows = [("b", "José Ñandú", "Ünter den Linden 1"), ("a", "Jose Ñandú", "Ünter den Linden 1"), ("c", "X", "Y")]
    df = spark.createDataFrame(rows, "id string, owner_name string, property_address string")
    got = dedup.find_duplicates(df.withColumn("parcel_id", F.lit(None).cast("string")), "id", matcher="ratio")
    assert {r.id: r.duplicate_group for r in got.collect()} == {"a": "a", "b": "a", "c": None}


def test_long_names_meet_at_similar_addresses_only(spark, monkeypatch):
    """Long names of common words: beyond short distances name keys say little, so addresses must part them first."""
    rng = random.Random(12)
    common = "smith jones family trust estate of the and heirs living revocable dated john mary".split()
    rows = []
    for i in range(600):
        name = " ".join(rng.choice(common) for _ in range(rng.randint(10, 22)))
        rows.append((i, name, f"{i * 7919 % 100003} {rng.choice(common)}{i % 37} road"))
    for i in range(0, 60, 3):  # the same with a small difference in the name, or in the address
        rows.append((1000 + i, rows[i][1] + " x", rows[i][2]))
        rows.append((2000 + i, rows[i][1], rows[i][2][:-1]))
    met = []
    plain = dedup.similar_pairs

    def counted(texts):
        met.extend(r["count"] for r in texts.groupBy("kind").count().collect() if r["kind"] != "address")
        return plain(texts)

    monkeypatch.setattr(dedup, "similar_pairs", counted)
    df = spark.createDataFrame(rows, "rec_idx int, owner_name string, property_address string")
    got = {(r["lo"], r["hi"]) for r in dedup.fuzzy_pairs(df).collect()}
    assert {(i, 1000 + i) for i in range(0, 60, 3)} <= got and {(i, 2000 + i) for i in range(0, 60, 3)} <= got
    assert max(met) <= 6 and sum(met) < 200  # names at one address, out of 640


def test_names_come_first_where_they_are_far_fewer(spark, monkeypatch):
    """Two streets of many numbers and a few names: the numbers meet at one name only, and no match is lost."""
    rng = random.Random(13)
    names = ["JOHN SMITH", "JOHN SMYTH", "MARY WALKER", "ROBERT YOUNG", "ACME HOLDINGS LLC"]
    rows = [(i, names[i % 5], f"{100 + i * 37 % 4001 + rng.randint(0, 9) * 10**5} {('NORTH EXTENSION STREET', 'OAK ROAD')[i % 2]}") for i in range(900)]
    kinds = []
    plain = dedup.similar_pairs
    monkeypatch.setattr(dedup, "similar_pairs", lambda t: (kinds.append({r["kind"] for r in t.select("kind").distinct().collect()}), plain(t))[1])
    df = spark.createDataFrame(rows, "rec_idx int, owner_name string, property_address string")
    got = sorted((r["lo"], r["hi"]) for r in dedup.fuzzy_pairs(df).collect())
    assert kinds[0] == {"name"} and kinds[1] <= {" ".join(sorted(n.lower().split())) for n in names}
    form = [(" ".join(sorted(n.lower().split())), " ".join(sorted(a.lower().split()))) for _, n, a in rows]
    alike = {(a, b): score(a, b) >= 90 for a, _ in form[:5] for b, _ in form[:5]}
    first = {f: i for i, f in reversed(list(enumerate(form)))}
    some = sorted(first.values())
    want = [(i, j) for i in some for j in some if i < j and alike[form[i][0], form[j][0]] and score(form[i][1], form[j][1]) >= 95]
    assert len(want) > 50 and got == want


def test_numbers_of_a_street_seldom_meet(spark):
    """700 numbers of a street of 27 to 29 symbols: what shares a key is a small part of all pairs, and none that matches is lost."""
    rng = random.Random(14)
    numbers = rng.sample(range(10_000, 110_000), 700)
    texts = [f"{n} extension north street" for n in numbers]
    table = cut(spark.createDataFrame([("address", 95, t) for t in texts], "kind string, threshold int, text string"), "street")
    ranged = similar._ranged(table.withColumns({"uses": F.lit(1).cast("bigint"), "asks": F.lit(True)}))
    assert similar._short_pairs(ranged).count() < 0.03 * len(texts) * (len(texts) - 1) / 2
    letters, texts = {t: Counter(t) for t in texts}, sorted(texts)
    near = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if 200 * (letters[a] & letters[b]).total() >= 94 * (len(a) + len(b))]
    want = {(a, b) for a, b in near if score(a, b) >= 95}
    assert len(want) > 50 and {(r["a"], r["b"]) for r in similar_pairs(table).collect()} == want


def test_candidates_meet_once_by_number(spark):
    """Keys carry a number and no text, and a pair that shares several keys is one candidate: it gets its texts once."""
    texts = [f"{n} extension north street" for n in range(12_300, 12_420)]
    table = cut(spark.createDataFrame([(k, 95, t, 3) for k in ("a", "b") for t in texts], "kind string, threshold int, text string, uses bigint"), "street")
    ranged = similar._ranged(table.withColumn("asks", F.col("kind") == "a"))
    got = [tuple(r) for r in similar._short_pairs(ranged).select("kind", "a", "b", "uses_a", "uses_b").collect()]
    assert len(got) == len(set(got)) and {(r[0], r[3], r[4]) for r in got} == {("a", 3, 3)}
    assert {r[1:3] for r in got} >= {(a, b) for a in texts for b in texts if a < b and score(a, b) >= 95}
    numbered = cut(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    assert dict(similar._role_keys(similar._roles(numbered)).dtypes) == {"_id": "bigint", "asks": "boolean", "key": "bigint"}


def test_find_duplicates_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(k):
        made.add(1)
        return f"PARCEL {k % 40}"

    parcel = F.udf(seen, "string").asNondeterministic()("rec_idx")
    text = F.concat(F.col("rec_idx").cast("string"), F.lit(" NORTH EXTENSION STREET"))
    rows = spark.range(60).select(F.col("id").alias("rec_idx"), F.lit("ANN LEE").alias("owner_name"), text.alias("property_address"), F.lit("2024-01-01").alias("sale_date"))
    rows = rows.withColumn("parcel_id", parcel)
    got = dedup.find_duplicates(rows, exact_fields=["parcel_id"])
    assert got.columns == [*rows.columns, "duplicate_group", "duplicate_kind"] and got.filter("duplicate_kind = 'exact'").count() == 40
    assert made.value == 60


def _cell(texts, parts, threshold, pair):
    """The texts as a cell of two parts, with their place as what pairs are given."""
    at = [i for i, p in enumerate(parts) if p in pair]
    rows = {"kind": "name", "threshold": threshold, "_lo_part": min(pair), "_hi_part": max(pair)}
    columns = {c: [v] * len(at) for c, v in rows.items()} | {"text": [texts[i] for i in at], "uses": at, "asks": [i % 3 > 0 for i in at]}
    return pa.table(columns | {"n": [len(texts[i]) for i in at], "_part": [parts[i] for i in at]}).to_batches()


@pytest.mark.parametrize("threshold, alphabet", [(80, "abcdeimnorst 0123456789"), (90, "ab"), (90, "".join(map(chr, range(0x4E00, 0x4E00 + 700))))])
def test_cells_give_matches_only(threshold, alphabet):
    """Bands of one number and of several, few and many symbols, lengths on both sides of a byte: all matches leave the cells, each once,
    with their scores and without their texts, and nothing else does."""
    rng = random.Random(threshold + len(alphabet))
    bases = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 9, 30, 62, 70, 100, 128, 190, 260, 330, 700)]
    texts = _mutations(rng, bases, 250, alphabet)
    parts = [rng.randrange(2) for _ in texts]
    found = []
    for pair in ((0, 0), (0, 1), (1, 1)):
        batches = cells.matches_of_cell(0, False)(iter(_cell(texts, parts, threshold, pair)))
        found += [tuple(r.values()) for b in batches for r in b.to_pylist()]

    def common(x, y):
        at, row = {}, (1 << len(x)) - 1
        for i, ch in enumerate(x):
            at[ch] = at.get(ch, 0) | 1 << i
        full = row
        for ch in y:
            hit = row & at.get(ch, 0)
            row = (row + hit | row - hit) & full
        return len(x) - row.bit_count()

    want = []
    for i, x in enumerate(texts):
        for j, y in enumerate(texts[i + 1 :], i + 1):
            if i % 3 or j % 3:
                s = round(100 * ((2 * common(x, y)) / (len(x) + len(y))))
                want += [("name", i, j, s)] if s >= threshold else []
    assert len(want) > 300 and sorted(found) == want


def test_names_without_address_take_their_vertices_along(spark):
    """Names of which each is one vertex meet no vertices afterwards: pairs hold neither texts nor a join."""
    base = "smith jones family trust of north carolina revocable living holdings properties"
    names = _mutations(random.Random(4), [base], 40, "abcdeimnorst")
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "rec_idx int, owner_name string, property_address string")
    pairs = dedup.fuzzy_pairs(df)
    form = [" ".join(sorted(n.split())) for n in names]
    first = {f: i for i, f in reversed(list(enumerate(form)))}
    some = sorted(first.values())
    want = [(i, j) for i in some for j in some if i < j and score(form[i], form[j]) >= 90]
    assert len(want) > 100 and sorted(map(tuple, pairs.collect())) == want
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_very_long_text_takes_no_room_for_the_others():
    """Some texts of 20,000 symbols in a cell of short ones: memory goes by the symbols there are, not by the longest text."""
    rng = random.Random(6)
    alphabet = "abcdeimnorst 0123456789"
    base = "".join(rng.choice(alphabet) for _ in range(20_000))
    short = {"".join(rng.choice(alphabet) for _ in range(rng.randint(60, 120))) for _ in range(600)}
    texts = [*sorted(short), base, base[:500] + base[600:], base + "zz" * 300, base[:15_000]]
    tracemalloc.start()
    batches = list(cells.matches_of_cell(0, False)(iter(_cell(texts, [0] * len(texts), 90, (0, 0)))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = {tuple(sorted((r["uses_a"], r["uses_b"]))): r["score"] for b in batches for r in b.to_pylist()}
    n = len(short)
    assert {(n, n + 1): 100, (n, n + 2): 99, (n + 1, n + 2): 98} == {k: v for k, v in found.items() if max(k) >= n}
    assert peak < 300e6
