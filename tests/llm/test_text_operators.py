"""The text operators against brute force, on small made-up documents with everything odd that a table may hold."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import common, labelled, line_crf, lm, minhash, packing, pieces, quality_rules, substrings, token_counts, toxicity, units
from recordloom.llm.components import components
from recordloom.llm.queries import BYTE_BPE, BYTE_BPE_RANKS, PIECE_BPE, QUERIES, vocabulary

# Names that the operators use for themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, row string, key string, score string, kept int"
GAP = re.compile("[^\x20\x09-\x0D]+")


def _frame(spark, texts, parts=3):
    rows = [(i, t, None if k % 5 == 0 else "en", "s", None if t is None else len(t), 1, "r", None, "x", 0) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def _words(rng, n, letters="abcdefg"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [_words(rng, rng.randint(0, 90)) for _ in range(40)]
    passage = _words(rng, 30)
    out = [" ".join(b) for b in base]
    for b in base[:20]:  # near copies, and passages in the middle of others
        c = list(b)
        for _ in range(len(c) // 30):
            c[rng.randrange(len(c))] = "new"
        out += [" ".join(c), "\n".join([" ".join(b[:10]), " ".join(passage), " ".join(b[10:])])]
    out += ["", "   \n\t ", "one", "One", None, None, out[3], out[3], "Ünï 漢字 😀  two　x <|endoftext|> it's", " ".join(_words(rng, 9000))]
    out += ["a b " * 40, "same line\nsame line\nother\n\nother", "x" * 5000]
    return [(k, t) for k, t in enumerate(out)] + [(3, out[3]), (None, out[5]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return _frame(spark, texts).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _by_id(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def test_hashes_tell_words_and_order_apart():
    texts = [b"a bc  d\n", b"", b"bc a", b"\xc3\xa9 a"]
    words, owner = common.word_hashes(texts)
    assert owner.tolist() == [0, 0, 0, 2, 2, 3, 3] and len(set(words.tolist())) == 4
    assert words[0] == words[4] == words[6]
    two = common.window_hashes(words[:5], 2)
    assert two[0] != two[3]
    assert (common.word_hashes([b"AbC"], lower=True)[0] == common.word_hashes([b"abc"])[0]).all()


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(_words(rng, 3000)).encode()
    whole = common.word_hashes([text])[0]
    monkeypatch.setattr(common, "_BLOCK", 100)
    assert (common.word_hashes([text])[0] == whole).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(1000, k) for k in range(1001, 1080)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_quality_rules(docs, texts, none):
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(texts) and quality_rules.judged(none).count() == 0
    want = []
    for i, t in texts:
        t = t or ""
        w = GAP.findall(t)
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeats = {j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if GAP.search(x)]
        failed = len(w) < 10 or 100 * len(repeats) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeats), failed))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert _by_id(got, *base) == sorted(want, key=str)
    assert not any(r["kept"] for r in got if r["base_failed"])


PROSE = """The mill stood at the bend of the river, and in spring the water rose to the second step of its old stone
stairs. Nobody in the village could say who had built it. A carpenter from the next valley came every autumn to mend
the wheel, and he was paid in flour and in apples. When he was asked why the work never ended, he said that wood is
like a guest: it is at home for a while, and then it wants to leave. Children liked to sit on the wall and watch the
grain run down the wooden channel. It was a quiet place for most of the year, but on the day of the fair there were
carts along the road to the bridge, and a fiddler played on the roof of the barn until the lamps went out."""


def test_quality_rules_tell_prose_from_symbols(spark):
    noise = " ".join(f"w{k}%%% THE### X{k}$$$" for k in range(60))
    shout = PROSE.upper()
    columns = " | ".join(f"term{k}" for k in range(80))
    got = quality_rules.judged(_frame(spark, [(1, PROSE), (2, noise), (3, shout), (4, columns), (5, "Eleven words are too few for a histogram to say anything.")]))
    assert {r["doc_id"]: r["kept"] for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_divergence_is_the_jensen_shannon_distance(spark):
    p, q = [5.0, 0.0, 3.0, 2.0], [0.25, 0.25, 0.5, 0.0]
    got = spark.range(1).select(quality_rules.divergence(F.array(*map(F.lit, p)), F.lit(10.0), q)).first()[0]
    a, b = np.array(p) / 10, np.array(q)
    m = (a + b) / 2
    with np.errstate(all="ignore"):
        want = math.sqrt(sum(np.nansum(x * np.log2(x / m)) for x in (a, b)) / 2)
    assert abs(got - want) < 1e-9


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTE_BPE))


def test_units_give_what_the_library_gives():
    rng = random.Random(3)
    parts = [*"ab Z9'.,!\n\t  éßа漢", "　", "\xa0", " ", "\x1c", "\x85", "​", "'s", " <|endoftext|>", "\r\n", "😀", "٣", "Ⅷ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    library, v = _library(), units.Vocabulary(vocabulary(BYTE_BPE), vocabulary(BYTE_BPE_RANKS), cache_bits=8, pool_size=500)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # with an empty and with a filled (and overflowing) cache
        assert [x.tolist() for x in v.ids([t.encode() for t in texts])] == want
    v.learn([b" ab", b"Z", " é".encode()], 6)
    assert v.lengths([t.encode() for t in texts]).tolist() == list(map(len, want))


def test_token_counts(docs, texts, none):
    library = _library()
    args = vocabulary(BYTE_BPE), vocabulary(BYTE_BPE_RANKS)
    got = token_counts.token_counts(docs, *args, limit=20).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in texts]
    assert _by_id(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.token_counts(none, *args).count() == 0


def _cleaned(texts, size=13):
    known = sorted({(i, t) for i, t in texts if i is not None}, key=lambda x: x[0])
    first: dict = {}
    for i, t in known:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, t in texts:
        w = (t or "").encode().split()
        drop = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                drop.update(range(k, k + size))
        out.append((i, len(w), len(drop), b" ".join(x for k, x in enumerate(w) if k not in drop).decode()))
    return out


@pytest.mark.parametrize("group", [1_500_000, 50])
def test_substring_dedup(docs, texts, none, group, monkeypatch):
    monkeypatch.setattr(substrings, "_GROUP", group)
    found = substrings.without_repeats(docs)
    got = found.collect()
    assert _by_id(got, "id", "n_words", "n_removed", "kept") == sorted(_cleaned(texts), key=str)
    assert sum(r["n_removed"] for r in got) > 500 and {r["row"]["score"] for r in got} == {"x"}
    assert substrings.without_repeats(none).count() == 0


def test_cover_is_a_difference_cover():
    for p in range(7):
        for q in range(7):
            assert any((p + s) % 7 in substrings.COVER and (q + s) % 7 in substrings.COVER for s in range(7))
    assert substrings.ANCHOR + 6 <= substrings.WINDOW


def _sets(texts, size):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for i, t in texts:
        w = GAP.findall((t or "").translate(lower))
        out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    return out


def _near_components(texts, size):
    sets = [(i, s) for i, s in _sets(texts, size) if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(docs, texts, none, size):
    got = minhash.near_duplicates(docs, size=size).collect()
    want = _near_components(texts, size)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert Counter(want.values()).most_common(1)[0][1] > 2 and len(got) == len(texts)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(s) for _, s in _sets(texts, size))
    assert minhash.near_duplicates(none, size=size).count() == 0


def test_minhash_families_without_an_original(spark):
    """Copies that are near to some of their kind only: no pivot meets them all."""
    rng = random.Random(8)
    texts = []
    for f in range(6):
        base = _words(rng, 60, "abcdefghijklmnop")
        for k in range(40):
            c = list(base)
            for p in rng.sample(range(60), rng.choice((2, 3, 4))):
                c[p] = f"e{rng.random()}"
            texts.append((f * 100 + k, " ".join(c)))
    docs = _frame(spark, texts, 4)
    want = _near_components(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, size=2).collect()} == want
    assert 1 < len(set(want.values())) < len(texts)


def test_blocks_of_a_bucket_lose_no_pair(spark):
    rng = random.Random(9)
    texts = [(k, " ".join(w if rng.random() > 0.02 else f"z{k}{p}" for p, w in enumerate(_words(random.Random(1), 50)))) for k in range(60)]
    docs = _frame(spark, texts, 4).select("doc_id", "text")
    members = spark.createDataFrame([(7, k) for k, _ in texts], "key bigint, id bigint")
    found = spark.createDataFrame([], "id bigint, component bigint")
    for block in (7, 1000):
        links = {(r["a"], r["b"]) for r in minhash._linked_across(members, found, docs, "doc_id", "text", 2, 80, block).collect()}
        sets = dict(_sets(texts, 2))
        assert links == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_packing(docs, texts, none):
    library = _library()
    args = vocabulary(BYTE_BPE), vocabulary(BYTE_BPE_RANKS)
    got = packing.packed(docs, *args, length=64, end=1, shard_tokens=3000).collect()
    ids = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in texts]
    # Every document is covered once: each piece is what its place says, and lengths add up.
    by = {}
    for i, x in ids:
        by.setdefault(i, []).append(x)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in by[r["doc_id"]])
    want = Counter((i, p) for i, x in ids for p in range(len(x)))
    assert Counter((r["doc_id"], p) for r in got for p in range(r["start"], r["start"] + r["length"])) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert packing.packed(none, *args).count() == 0


def test_seeds_are_followed_by_their_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(k * 100, k * 100 + 100, 400) for k in range(4)]
    docs = [rng.choice(topics[k % 4], 50) for k in range(40)]
    idf = np.log(1 + 40 / (1 + np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=500)))
    packed = packing.packed_shard(docs, idf, 50.0, 200)
    order = [p[0] for p in sorted(packed, key=lambda p: (p[3], p[4]))]
    order = list(dict.fromkeys(order))
    same = sum(a % 4 == b % 4 for a, b in zip(order, order[1:]))
    assert same > 25  # by chance, about 10


def _paths(unit, model, known):
    if not unit:
        return [()]
    return [(known[unit[:n]], *rest) for n in range(1, min(16, len(unit)) + 1) if unit[:n] in known for rest in _paths(unit[n:], model, known)]


def test_piece_samples_have_the_right_distribution():
    model = pieces.Model(vocabulary(PIECE_BPE))
    known = {model.library.id_to_piece(i): i for i in range(3, model.library.get_piece_size()) if not model.library.is_byte(i)}
    every = [(0.0, ())]
    for unit in ("▁xq", "▁erhe"):
        paths = _paths(unit, model, known)
        w = np.array([sum(model.logit[i] for i in p) for p in paths])
        w -= np.log(np.exp(w).sum())
        every = [(a + b, x + y) for a, x in every for b, y in zip(w, paths)]
    p = {x: math.exp(a) for a, x in every}
    assert abs(sum(p.values()) - 1) < 1e-9
    n = 6000
    drawn = pieces.top_segmentations(["xq erhe"] * n, [int(x) for x in np.random.default_rng(3).integers(0, 2**63, n)], 3, model)
    first, weighed = Counter(), Counter()
    for rows in drawn:
        ids = [tuple(r[3].tolist()) for r in rows]
        assert len(set(ids)) == 3 and rows[0][1] >= rows[1][1] >= rows[2][1]
        assert all(abs(math.exp(r[0]) - p[i]) < 1e-9 for r, i in zip(rows, ids))
        first[ids[0]] += 1
        for r, i in zip(rows, ids):
            weighed[i] += math.exp(-r[2])  # by inclusion, every path counts once on average
    for path in sorted(p, key=p.get)[-3:]:
        assert abs(first[path] / n - p[path]) < 4 * math.sqrt(p[path] * (1 - p[path]) / n) + 1e-3
    assert abs(weighed[max(p, key=p.get)] / n - 1) < 0.02


def test_piece_sampling(docs, texts, none):
    path = vocabulary(PIECE_BPE)
    got = pieces.sampled(docs, path, k=3).collect()
    model = pieces.Model(path)
    assert all(r["round_trip"] for r in got)
    seen: dict = {}
    for r in got:
        seen.setdefault((r["doc_id"], r["sample"]), []).append(r)
    by = {i: t or "" for i, t in texts if i is not None}
    for (i, n), rows in seen.items():
        if i is not None:
            assert model.decoded([list(rows[0]["ids"])]) == [by[i]]
            assert n == 1 or tuple(seen[i, n - 1][0]["ids"]) != tuple(rows[0]["ids"])
    assert {n for i, n in seen if i is not None and by[i] == ""} == {1}
    again = pieces.sampled(docs.repartition(2), path, k=3).collect()
    assert _by_id(again, "doc_id", "sample", "ids", "perturbed") == _by_id(got, "doc_id", "sample", "ids", "perturbed")
    texts_ = [by[i] for i in by]
    assert model.decoded(model.encoded(texts_)) == texts_
    assert pieces.sampled(none, path).count() == 0


def test_lattices_are_kept(texts, monkeypatch):
    """A worker keeps the lattices of units, and results don't depend on which."""
    some = [t or "" for _, t in texts] + ["the cat  the dog", "a\u2581b \u2581 c", "<s> \ufb01 \u3000x\x00", " ", "\t\n", "the cat"]
    model = pieces.Model(vocabulary(PIECE_BPE), best=True)
    keys = list(range(len(some)))

    def drawn(of):
        return [[(*r[:3], r[3].tolist()) for r in rows] for rows in pieces.top_segmentations(some, keys, 3, of)]

    first = drawn(model)
    built = model.lattices.hash.used
    assert drawn(model) == first and model.lattices.hash.used - built < built / 100  # but for units that meet in a slot
    monkeypatch.setattr(pieces, "_KEPT", 3000)
    few = pieces.Model(vocabulary(PIECE_BPE), best=True)
    trimmed = []
    trim = few.lattices._trim
    monkeypatch.setattr(few.lattices, "_trim", lambda: (trim(), trimmed.append(few.lattices.hash.used)))
    for _ in range(3):
        for i in range(0, len(some), 7):
            work = pieces._run(some[i : i + 7], keys[i : i + 7], 3, few)
            assert [[(*r[:3], r[3].tolist()) for r in rows] for rows in work.samples()] == first[i : i + 7]
            assert [x.tolist() for x in work.best()] == model.encoded(some[i : i + 7])
    assert any(trimmed)


def test_best_pieces_that_units_do_not_give(monkeypatch):
    """Where the library encodes a unit in another way than in its text, the text is encoded whole."""
    model = pieces.Model(vocabulary(PIECE_BPE), best=True)
    whole, calls = model.encoded, []

    def encoded(some):
        calls.append(some)
        return [i[:-1] if len(calls) == 1 and t == "dog" else i for t, i in zip(some, whole(some))]

    monkeypatch.setattr(model, "encoded", encoded)
    some = ["the cat", "", "the dog", "dog"]
    assert [x.tolist() for x in pieces._run(some, [1, 2, 3, 4], 2, model).best()] == whole(some)
    assert calls[1:] == [["the dog"], ["dog"]]


def test_pieces_of_documents(spark, docs, texts, tmp_path):
    path = vocabulary(PIECE_BPE)
    model = pieces.Model(path)
    back = pieces.decoded(pieces.encoded(docs, path, into="ids_"), path, ids="ids_", into="decoded_").collect()
    assert len(back) == len(texts) and all(r["ids_"] == model.encoded([r["text"] or ""])[0] and r["decoded_"] == (r["text"] or "") for r in back)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_piece_sampling"](spark, str(tmp_path)).collect()
    best = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in got if r["sample"] == 0)
    assert best == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids_"]) for r in back)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)
    drawn = pieces.sampled(docs, path, k=2).collect()
    assert _by_id(drawn, "doc_id", "sample", "ids") == _by_id([r for r in got if r["sample"]], "doc_id", "sample", "ids")


def test_language_model(spark, texts, docs, none):
    rng = random.Random(5)
    follow = {w: rng.choice("bcdefghij") for w in "abcdefghij"}

    def chain(n):
        out = [rng.choice("abcdefghij")]
        while len(out) < n:
            out.append(follow[out[-1]] if rng.random() < 0.9 else rng.choice("abcdefghij"))
        return out

    train = _frame(spark, [(k, " ".join(chain(200))) for k in range(400)], 4)
    words, weights = lm.train(train, alone=8, buckets=8, rate=0.2)
    start = lm.Network(words.size, 16, 24)
    net = lm.Network(words.size, 16, 24, weights)
    own = chain(2000)
    mixed = list(own)
    rng.shuffle(mixed)
    sample = [" ".join(own).encode(), " ".join(mixed).encode(), b""]
    trained, counts = lm.log_likelihoods(sample, words, net)
    untrained, _ = lm.log_likelihoods(sample, words, start)
    assert counts.tolist() == [2000, 2000, 0] and trained[2] == 0
    assert trained[0] > untrained[0] + 500 and trained[0] > trained[1] + 500
    got = lm.scored(docs, lm.train(docs)).collect()
    assert len(got) == len(texts) and all(r["log_likelihood"] <= 0 for r in got)
    assert all((r["mean_log_likelihood"] is None) == (r["n_words"] == 0) for r in got)
    assert lm.scored(none, lm.train(none)).count() == 0


def _hash_of(*some):
    return common.word_hashes([" ".join(some).encode()], lower=True)[0]


def test_all_words_are_counted(spark):
    rows = [(k, " ".join([f"w{k}x{i}" for i in range(2000)] + ["once", "More", "more"])) for k in range(40)]
    w = lm.words(_frame(spark, rows, 40), "text")  # "once" is never seen twice in a task
    assert w.of(_hash_of("more", "once")).tolist() == [0, 1]
    assert len(w.hashes) == 4 * math.isqrt(80_002) and w.kinds == 2 * (math.isqrt(80_002) // 4)  # both grow
    every = np.concatenate([_hash_of(*(f"w{k}x{i}" for i in range(2000))) for k in range(40)] + [_hash_of("once", "more")])
    numbers = w.of(every)
    total = np.bincount(w.classes[numbers], np.exp(w.share[numbers]), w.kinds)
    own = np.arange(w.kinds) < w.kinds - w.buckets
    unseen = np.exp(w.share[len(w.hashes) :])
    assert np.allclose(total[own], 1) and np.allclose(total[~own] + unseen, 1)  # one unseen word a bucket
    # A word that was never seen is no likelier than a rare one of its class that is known.
    rare = numbers[(numbers < len(w.hashes)) & (w.classes[numbers] >= w.kinds - w.buckets)]
    assert len(rare) and (w.share[len(w.hashes) + w.classes[rare] - (w.kinds - w.buckets)] <= w.share[rare] + 1e-9).all()
    small = lm.words(_frame(spark, rows, 2), "text", known=50, alone=8, buckets=7, room=3000)  # handed on in parts
    assert len(small.hashes) == 50 and small.of(_hash_of("more", "once")).tolist() == [0, 1]
    of = (every % np.uint64(7)).astype(int)
    times = np.ones(len(every))
    times[-2:] = 40, 80
    assert np.isclose(np.exp(small.share[0]), 1)
    unknown = small.of(every) >= 50
    mass = 1 + np.bincount(of[unknown], times[unknown], 7)
    known = np.bincount(of[~unknown & (small.of(every) >= 8)], minlength=7)
    assert np.allclose(np.exp(small.share[50:]), mass / (mass + known) / (1 + np.bincount(of[unknown], minlength=7)))


def test_every_word_is_a_target(monkeypatch):
    texts = ["", None, "a b", "b a", "one", " ".join(_words(random.Random(2), 3000))]
    hashes = np.unique(common.word_hashes([common.utf8(t) for t in texts])[0])
    numbered = lm.Words(hashes, np.arange(len(hashes)), np.append(np.arange(len(hashes)), len(hashes)), np.zeros(len(hashes) + 1), 1)
    targets = Counter()
    step = lm.Network.step
    monkeypatch.setattr(lm.Network, "step", lambda self, run_of, at, target, rate: (targets.update(target.tolist()), step(self, run_of, at, target, rate))[1])
    start = lm.Network(numbered.size, numbered.kinds, 4).weights
    run = lm._trained(mock.Mock(value=numbered), mock.Mock(value=start), numbered.kinds, 4, 0.1, batch_size=64)
    out = list(run([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    every = numbered.of(common.word_hashes([common.utf8(t) for t in texts])[0])
    assert targets == Counter(every.tolist()) and out[0].column(1)[0].as_py() == len(every) == 3005


def _context_logs(net, numbers, none):
    """Word by word: the log-probability of every class in the context of each word of one text."""
    width, out = net.width, []
    for i in range(len(numbers)):
        h = np.zeros(width)
        for k, p in enumerate(lm.PLACES):
            n = numbers[i + p] if 0 <= i + p < len(numbers) else none
            h += net.place[n, k * width : (k + 1) * width]
        h = np.tanh(h)
        groups = np.exp(h @ net.group + net.group_bias)
        inner = [np.exp(h @ net.out[g] + net.bias[g]) for g in range(len(net.bias))]
        out.append(np.log(np.concatenate([groups[g] / groups.sum() * x / x.sum() for g, x in enumerate(inner)]) + 1e-300))
    return np.array(out).reshape(len(numbers), net.bias.size)


@pytest.mark.parametrize("classes", [1, 2, 5, 16, 23])
def test_likelihoods_word_by_word(classes):
    rng = np.random.default_rng(classes)
    texts = [b"a b c a", b"", b"zz Q a", b"b"]
    known = np.unique(common.word_hashes([b"a b c"])[0])
    kinds = np.append(rng.integers(0, classes, 3), [0] * 2 + [classes - 1])
    w = lm.Words(known, np.arange(3), kinds, rng.normal(size=6), 3)
    net = lm.Network(w.size, w.kinds, 5)
    real = net.bias.ravel()[:classes]
    real += rng.normal(size=classes).astype(np.float32)
    total, counts = lm.log_likelihoods(texts, w, net)
    for k, t in enumerate(texts):
        numbers = w.of(common.word_hashes([t], lower=True)[0])
        logs = _context_logs(net, numbers, w.size)
        assert np.allclose(np.exp(logs[:, :classes]).sum(1), 1, atol=1e-5)  # the classes that exist share all the mass
        want = sum(logs[i, w.classes[n]] + w.share[n] for i, n in enumerate(numbers))
        assert counts[k] == len(numbers) and np.isclose(total[k], want, atol=1e-4)


def test_a_step_follows_the_slope():
    rng = np.random.default_rng(1)
    numbers, at = rng.integers(0, 9, 40).astype(np.int32), np.arange(2, 38)
    target = rng.integers(0, 7, len(at))
    net = lm.Network(9, 7, 4)
    loss = lambda: -float(net.logs(net.hidden(numbers, at), target).astype(float).mean())
    before, weights = [s.copy() for s in net.squares], net.weights.copy()
    net.step(numbers, at, target, 0.0)
    grads = np.concatenate([np.sqrt(np.maximum(a - b, 0)).ravel() for a, b in zip(net.squares, before)])  # their sizes
    some = rng.choice(np.flatnonzero(np.abs(weights) < 1e8), 60, replace=False)
    for i in some:
        net.weights[i] = weights[i] + 2e-2
        up = loss()
        net.weights[i] = weights[i] - 2e-2
        down = loss()
        net.weights[i] = weights[i]
        assert abs(abs(up - down) / 4e-2 - grads[i]) < 2e-3
    start = loss()
    for _ in range(30):
        net.step(numbers, at, target, 0.1)
    assert loss() < start - 0.1


def _good(rng):
    return "\n".join(" ".join(_words(rng, rng.randint(6, 14))).capitalize() + "." for _ in range(rng.randint(1, 8)))


def _bad(rng):
    return "\n".join(" ".join(w.upper() + "!!" for w in _words(rng, rng.randint(6, 14))) for _ in range(rng.randint(1, 8)))


def test_line_field():
    rng = random.Random(6)
    sample = [(_good(rng).encode(), 1) for _ in range(150)] + [(_bad(rng).encode(), 0) for _ in range(100)]
    sample += [((_good(rng) + "\n" + _bad(rng)).encode(), 0) for _ in range(50)]
    model = line_crf.fit(sample, steps=60)
    good, bad, half = (line_crf.scores([f(rng).encode() for _ in range(50)], model) for f in (_good, _bad, lambda r: _good(r) + "\n" + _bad(r)))
    assert (good >= 0.3).mean() > 0.95 and (bad < 0.3).mean() > 0.95 and (half < 0.3).mean() > 0.8
    p, _, owner = line_crf.line_marginals([b"Abc def ghi.\nABC!! DEF!! GHI!! JKL!!\n\nAbc def ghi."], model)
    assert len(p) == 3 and p[1] < min(p[0], p[2])
    assert line_crf.scores([b"", b" \n"], model).tolist() == [0.0, 0.0]
    assert line_crf.scores([b"", b"x"], line_crf.fit([(b"x", 1)])).tolist() == [0.0, 1.0]


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    owner = np.array([0, 0, 0, 1, 2, 2])
    score, tr = rng.normal(size=6), rng.normal(size=(2, 2))
    got, pairs = line_crf.marginals(score, tr, line_crf._chains(owner))
    want, links = np.zeros(6), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(owner == d)
        total = 0.0
        for labels in np.ndindex(*[2] * len(at)):
            w = math.exp(sum(score[i] * y for i, y in zip(at, labels)) + sum(tr[a, b] for a, b in zip(labels, labels[1:])))
            total += w
        for labels in np.ndindex(*[2] * len(at)):
            w = math.exp(sum(score[i] * y for i, y in zip(at, labels)) + sum(tr[a, b] for a, b in zip(labels, labels[1:]))) / total
            want[at] += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                links[a, b] += w
    assert np.allclose(got, want) and np.allclose(pairs, links)


def _scorer(model, **limits):
    scorer = toxicity.Scorer(model, **limits)
    return lambda text: float(scorer.scores([text])[0])


def test_toxicity():
    rng = random.Random(7)

    def text(toxic):
        w = _words(rng, rng.randint(20, 120), "aeiourstln")
        for _ in range(max(1, len(w) // 25) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["grumblefex", "snorkwazzle", "plimpfozz"])
        return " ".join(w).encode()

    sample = [(text(y), y) for y in (0, 1) for _ in range(500)]
    model = toxicity.fit(sample)
    score = _scorer(model)
    assert np.mean([score(text(1)) >= 0.7 for _ in range(60)]) > 0.8
    assert np.mean([score(text(0)) < 0.7 for _ in range(60)]) > 0.95
    plain = text(0)
    assert score(plain + b" snorkwazle plimpfoz") > score(plain)  # misspelt
    assert score(b"") < 0.3 and score("語 漢字 слово".encode()) < 0.5
    nothing = toxicity.fit([(b"x", 0)])
    assert _scorer(nothing)(b"x") == 0


def test_toxicity_of_repeated_words():
    model = toxicity.Model(np.zeros(1 << 16), -1.0, (1.0, 0.0), 12, "test")
    bad = [f"grumblefex{c}".encode() for c in "abcdefghijkl"]
    model.rows[toxicity.grams(bad, 1 << 16)[0]] = 12.0
    score = _scorer(model)
    rng = random.Random(3)
    plain = [w.encode() for w in _words(rng, 4000, "uvwyz")]
    for i, w in enumerate(bad):
        plain[300 * i + 50] = w  # each singly, among harmless words
    assert score(b" ".join(plain)) < 0.6 and score(b" ".join(plain + bad + plain[100:200])) > 0.99
    assert score(b" ".join(plain[60:300] + bad[:1] * 12)) > 0.99  # one word again and again
    # In training as well: the toxic texts have the words of the others, in runs.
    def text(toxic):
        w = [rng.choice(["red", "blue", "green", "cyan", "pink", "grey"]) for _ in range(60)]
        if toxic:
            w[30:42] = ["pink"] * 12
        return " ".join(w).encode()

    score = _scorer(toxicity.fit([(text(y), y) for y in (0, 1) for _ in range(300)]))
    assert np.mean([score(text(1)) > score(text(0)) for _ in range(60)]) > 0.9


def _naive_toxicity(text: bytes, m) -> float:
    """Bag by bag, word by word."""

    def margin(word):
        rows, at = toxicity.grams([word], len(m.rows))
        marked = "<" + word.decode("utf-8", "replace").lower().strip(toxicity._STRIP) + ">"
        assert at.tolist() == [0, len(rows)]
        assert len(rows) <= len({marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)} | {marked}) <= len(rows) + 1
        return sum(m.rows[r] for r in rows) / len(rows)

    words = text.split()
    if not words:
        return 1 / (1 + math.exp(-(m.curve[0] * m.bias + m.curve[1])))
    begins = {*range(0, max(1, len(words) - m.window + 1), m.window // 2), max(0, len(words) - m.window)}
    best = max(sum(bag) / len(bag) for bag in ([margin(w) for w in words[i : i + m.window]] for i in begins))
    return 1 / (1 + math.exp(-(m.curve[0] * (best + m.bias) + m.curve[1])))


def test_toxicity_is_the_worst_bag_of_n_grams(texts):
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=1 << 12), 0.3, (0.7, -0.2), 12, "naive")
    every = [common.utf8(t) for _, t in texts] + [b"!!! ? . --", "ÄÖÜ ΣΑΣ İ ﬀ".encode(), b"a" * 30, b"\xff\xfe broken"]
    for bits in (20, 3):  # a table with room for all words, and one with next to none
        scorer = toxicity.Scorer(model, bits)
        together = scorer.scores(every)
        assert np.allclose(together, [_naive_toxicity(t, model) for t in every], atol=1e-12)
        assert together.tolist() == scorer.scores(every).tolist() == [float(scorer.scores([t])[0]) for t in every]


def test_very_long_words_are_hashed_in_parts(monkeypatch):
    word = "".join(random.Random(1).choice("abcdé") for _ in range(3000)).encode()
    rows, begin = toxicity.grams([word, b"short", word], 1 << 40)
    monkeypatch.setattr(toxicity, "_PART", 100)
    parts, at = toxicity.grams([word, b"short", word], 1 << 40)
    whole = set(rows[: begin[1]].tolist())
    assert len(whole - set(parts[: at[1]].tolist())) == 1 and set(parts[: at[1]].tolist()) < whole  # all but the word's own


def test_classifiers_on_odd_tables(spark, docs, texts, none):
    docs, none = docs.withColumn("y", F.lit("taken")), none.withColumn("y", F.lit("taken"))
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(60)] + [(1, 0, 1), (2, None, None), (None, 1, 1), (9999, 1, 0)], "doc_id bigint, quality int, toxic int")
    for train, scored in ((line_crf.train, line_crf.scored), (toxicity.train, toxicity.scored)):
        out = scored(docs, train(docs, labels, F.lit(True)), into="score_").collect()
        assert len(out) == len(texts) and all(0 <= r["score_"] <= 1 for r in out)
        assert scored(none, train(none, labels.limit(0), F.lit(True)), into="score_").count() == 0


def test_labelled_sample_is_full_where_ids_are_missing(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id bigint, toxic int")
    rows = [(k, "x" * 50 if k % 200 < 20 else f"text {k}") for k in range(4000) if k % 100 < 20]  # most have no document, some a long one
    sample = labelled.labelled_texts(_frame(spark, rows), labels, "toxic", F.lit(True), 30, 40)
    assert Counter(y for _, y in sample) == {0: 30, 1: 30}
    assert all(int(t.split()[1]) % 2 == y for t, y in sample) and len({t for t, _ in sample}) == 60


def test_lines_beyond_the_first_are_fitted_on(monkeypatch):
    given = []
    features = line_crf.line_features
    monkeypatch.setattr(line_crf, "line_features", lambda texts: (given.append(texts), features(texts))[1])
    sample = [(b"\n".join(b"line %d of text %d" % (k, i) for k in range(250 + i)), i % 2) for i in range(8)]
    line_crf.fit(sample, steps=2)
    assert given == [[t for t, _ in sample]]
    line_crf.fit(sample, steps=2, most_lines=600)
    assert given[1] == [t for t, _ in sample[:4]]  # whole ones only, two of either class


def test_kept_digest(docs, texts):
    found = substrings.without_repeats(docs.select("doc_id", "text"))
    got = _by_id(found.select("id", F.sha2("kept", 256).alias("d")).collect(), "id", "d")
    assert got == sorted(((i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in _cleaned(texts)), key=str)
