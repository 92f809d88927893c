"""The pipeline on a small corpus, stage by stage."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from recordloom.llm.queries import QUERIES


def _words(rng, n):
    return ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def _lines(words):
    return "\n".join(" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, len(words), 12))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(300):
        w = _words(rng, rng.randint(40, 160))
        kind = ("bad", "toxic", "good", "good")[k % 4]
        if kind == "toxic":
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["grumblefex", "snorkwazzle"])
        text = _lines(w) if kind != "bad" else " | ".join(x.upper() + "###" for x in w)
        docs.append((k, text))
        labels.append((k, int(kind != "bad"), int(kind == "toxic")))
    good = [t for (k, t) in docs if k % 4 > 1]
    docs += [(1000 + k, t) for k, t in enumerate(good[:10])]  # copies
    passage = " ".join(_words(rng, 60))
    docs += [(2000 + k, t + "\n" + passage) for k, t in enumerate(_lines(_words(rng, 150)) for _ in range(5))]
    docs += [(3000, None), (3001, "")]
    where = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, dict(docs)


def test_stages(spark, corpus, tmp_path):
    where, texts = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    first = ids["quality_classifier"]
    assert not {3000, 3001} & first and len([i for i in first if i < 300 and i % 4 == 0]) < 5
    assert len([i for i in first if i < 300 and i % 4]) > 215
    second = ids["toxicity"]
    assert len([i for i in second if i < 300 and i % 4 == 1]) <= 22 and len([i for i in second if i < 300 and i % 4 > 1]) > 140
    third = ids["minhash_near_dedup"]
    assert not {i for i in third if 1000 <= i < 2000} and third < second and {i for i in second if i < 300} <= third
    fourth = {r["doc_id"]: r for r in kept["substring_dedup"]}
    assert fourth.keys() == third and all(r["n_chars"] == len(r["text"]) for r in fourth.values())
    before = {r["doc_id"]: r["text"] for r in kept["minhash_near_dedup"]}
    shared = sorted(i for i in third if i >= 2000)
    lost = [len(before[i].split()) - len(fourth[i]["text"].split()) for i in shared]
    assert lost[0] == 0 and set(lost[1:]) == {60}
    assert ids["packing"] == third
    done = corpus_pipeline.run(spark, where)
    # The same documents with the same numbers of tokens as stage by stage; where they are cut may differ.
    sizes = lambda rows: {(r["doc_id"], r["doc_tokens"]) for r in rows}
    packed = done.collect()
    assert sizes(packed) == sizes(kept["packing"]) and {i for i, _ in sizes(packed)} == third
    assert sum(r["length"] for r in packed) == sum(n for _, n in sizes(packed))


def test_names():
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "minhash_near_dedup", "substring_dedup", "packing"]
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 14)) and len(QUERIES) == 13
