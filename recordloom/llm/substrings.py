"""Repeated passages across documents, found through difference-cover anchors.

A window of ``WINDOW`` (13) words is a repeat if it also starts in a document with a smaller id. Hashing all windows
would shuffle every word's hash. Instead:

1. Anchors: hashes of ``ANCHOR`` (7) words, only where the word's position modulo 7 is 0, 1 or 3. These residues are a
   difference cover: for any two positions p and q there is a shift below 7 with both p + shift and q + shift in the
   cover. 7 words from there still lie inside 13, so two equal windows always share an aligned anchor.
2. Extension: only windows around an anchor that another document has as well are hashed, on all their 13 words (96
   bits). Per hash, all documents but the one of the least id hold a repeat.
3. Every document takes out the words that its repeats cover.

Whole texts that an earlier document has as well are found by a hash of the text beforehand: their windows are all
repeats, and they take no part in steps 1 and 2. Both hash exchanges are free of hot keys: a task first compares the documents it has read itself. Anchors that several
of them have are settled on the spot, as are windows that one of them with a smaller id has, and only one row for
each hash and group of documents is shuffled by the hash. A passage of a third of all documents so makes as many rows as there are groups.
The texts are shuffled once by id, and that exchange serves all steps.

Words are runs of other bytes than white space, unchanged. Null, empty and blank texts have no words; texts of fewer
than 13 words have no window. Rows that share an id count as one document, so they don't remove words from each other.
A row without id neither loses words nor makes others lose any. Other columns are handed on in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import many, mixed, on_workers, pieces, utf8, window_hashes, word_hashes

WINDOW, ANCHOR = 13, 7
#: Every difference modulo 7 is one of two of these.
COVER = (0, 1, 3)
_IN_COVER = np.isin(np.arange(ANCHOR), COVER)
#: Hashes that a task compares among themselves before it hands them on.
_GROUP = 1_500_000
_ROWS = "key bigint, id bigint, sure bigint, other int"


def _placed(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every word: its position in its text, and the words of that text."""
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    return np.arange(len(owner)) - bounds[owner], np.diff(bounds)[owner]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text position and word number (within the run of texts) of every anchor."""
    words, owner = word_hashes(texts)
    runs = window_hashes(words, ANCHOR)
    if not len(runs):
        return runs, owner[:0], owner[:0]
    at, of = _placed(owner, len(texts))
    at, of = at[: len(runs)], of[: len(runs)]
    some = np.flatnonzero(_IN_COVER[at % ANCHOR] & (at + ANCHOR <= of) & (of >= WINDOW))
    return runs[some], owner[some], some


def windows_at(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window, of 64 and of 32 bits."""
    return window_hashes(words, WINDOW, 0), (window_hashes(words, WINDOW, 1) >> np.uint64(32)).astype(np.uint32)


def _batch(key, ids, sure, other) -> pa.RecordBatch:
    """``sure`` is a hash that is settled (such rows are dealt out by a mix of hash and id), or nothing."""
    arrays = [pa.array(key.view(np.int64)), pa.array(ids), pa.array(sure[0].view(np.int64), mask=~sure[1]), pa.array(other.view(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "sure", "other"])


def _split(key, ids, other, settled, hand_on):
    """Rows that are settled, and rows to be compared with those of other tasks."""
    zero = np.zeros(1, other.dtype)
    a, b = np.flatnonzero(settled), np.flatnonzero(hand_on)
    spread = mixed(key[a] + mixed(ids[a].view(np.uint64)))
    return _batch(
        np.concatenate([spread, key[b]]), np.concatenate([ids[a], ids[b]]),
        (np.concatenate([key[a], key[b]]), np.arange(len(a) + len(b)) < len(a)), np.concatenate([np.repeat(zero, len(a)), other[b]]),
    )


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _compared_anchors(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    once = _first_of(key, ids)
    key, ids = key[once], ids[once]
    first = _first_of(key)
    # A run of more than one document.
    run = np.cumsum(first) - 1
    return _split(key, ids, np.zeros(len(key), np.uint32), (np.bincount(run) > 1)[run] if len(run) else first, first)


def _compared_windows(key: np.ndarray, other: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((ids, other, key))
    key, other, ids = key[order], other[order], ids[order]
    once = _first_of(key, other, ids)
    key, other, ids = key[once], other[once], ids[once]
    first = _first_of(key, other)
    return _split(key, ids, other, ~first, first)


def _grouped(parts, compare):
    """Arrays of hashes in groups, compared among themselves."""
    held, size = [], 0
    for some in parts:
        if len(some[0]):
            held.append(some)
            size += len(some[0])
        if size >= _GROUP:
            yield from many(compare(*map(np.concatenate, zip(*held))))
            held, size = [], 0
    if held:
        yield from many(compare(*map(np.concatenate, zip(*held))))


def _anchor_rows(batches):
    def parts():
        for batch in batches:
            batch = batch.filter(batch.column(2).is_null())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, texts in pieces(utf8(t) for t in batch.column(1).to_pylist()):
                key, owner, _ = anchors(texts)
                yield key, ids[start + owner]

    return (b.select(["key", "id", "sure"]) for b in _grouped(parts(), _compared_anchors))


def _copies(known: DataFrame) -> DataFrame:
    """Ids of documents whose whole text an earlier one has, with the texts' hashes (128 bits are compared; no text is shuffled)."""
    seeds = F.xxhash64("body"), F.xxhash64("body", F.lit(1))
    hashed = known.where(F.col("body").isNotNull()).select("id", seeds[0].alias("h"), seeds[1].alias("g"))
    first = hashed.groupBy("h", "g").agg(F.min("id").alias("first"))
    return hashed.join(first, ["h", "g"]).where("id > first").groupBy("id").agg(F.collect_set("h").alias("copies"))


def _hits(of: pa.ListArray, i: int) -> np.ndarray:
    return of[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if of[i].is_valid else np.zeros(0, np.uint64)


def _window_rows(batches):
    def parts():
        for batch in batches:
            ids, hits = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            some = [i for i in range(batch.num_rows) if hits[i].is_valid]
            for start, texts in pieces(utf8(batch.column(1)[i].as_py()) for i in some):
                words, owner = word_hashes(texts)
                key, of, at = anchors(texts)
                bounds = np.searchsorted(of, np.arange(len(texts) + 1))
                found = [at[a:b][np.isin(key[a:b], _hits(hits, some[start + k]))] for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                hit = np.concatenate(found)
                # Windows that hold an anchor begin at most ANCHOR - 1 words before it.
                near = np.zeros(len(words) + 1, np.int64)
                np.add.at(near, np.maximum(hit - ANCHOR + 1, 0), 1)
                np.subtract.at(near, hit + 1, 1)
                one, two = windows_at(words)
                place, size = _placed(owner, len(texts))
                wanted = np.cumsum(near)[: len(one)] > 0
                wanted &= (place + WINDOW <= size)[: len(one)]
                yield one[wanted], two[wanted], ids[[some[start + o] for o in owner[: len(one)][wanted]]]

    return _grouped(parts(), _compared_windows)


def _settled(batches, least: bool):
    """(id, hash) of what is settled: rows that came so, and runs of equal keys in the sorted rest.

    With ``least``, all of a run but the rows of its least id; without, all rows of a run of several.
    """
    held = None
    for batch in batches:
        key, ids, other = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        sure = batch.column(2)
        known = sure.is_valid().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(ids[known]), sure.filter(pa.array(known))], names=["id", "hash"])
        key, ids, other = key[~known], ids[~known], other[~known]
        told = np.zeros(len(key), bool)
        if held is not None:  # the last row so far, the first of its run if ``least``
            key, ids, other, told = (np.concatenate([[x], y]) for x, y in zip(held, (key, ids, other, told)))
        if not len(key):
            continue
        first = _first_of(key, other)
        run = np.cumsum(first) - 1
        if least:
            out = ids > ids[np.flatnonzero(first)][run]
            last = np.flatnonzero(first)[-1]
            held = key[-1], ids[last], other[-1], True
        else:
            out = (np.bincount(run) > 1)[run]
            held = key[-1], ids[-1], other[-1], bool(out[-1] or told[-1])
        out &= ~told
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(key[out])], names=["id", "hash"])


def _by_id(rows: DataFrame, least: bool) -> DataFrame:
    """The settled hashes of every document; as many as it has itself."""
    dealt = rows.repartition("key")
    dealt = dealt if least else dealt.withColumn("other", F.lit(0))
    dealt = dealt.sortWithinPartitions("key", "other", "id")
    found = dealt.mapInArrow(lambda x: _settled(x, least), "id bigint, hash bigint")
    return found.groupBy("id").agg(F.collect_set("hash").alias("hits"))


def covered(words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Which words of a text lie in a window with one of the hashes."""
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(window_hashes(words, WINDOW, 0), hits))
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return np.cumsum(edge)[:-1] > 0


def _cleaned(batches):
    for batch in batches:
        ids, texts, hits, row, copy = (batch.column(k) for k in range(5))
        kept, n, removed = [], [], []
        for i in range(batch.num_rows):
            text = utf8(texts[i].as_py())
            parts = text.split()
            n.append(len(parts))
            if copy[i].is_valid and len(parts) >= WINDOW:
                parts = []
            elif hits[i].is_valid and len(parts) >= WINDOW:
                drop = covered(word_hashes([text])[0], _hits(hits, i))
                parts = [w for w, d in zip(parts, drop.tolist()) if not d]
            removed.append(n[-1] - len(parts))
            kept.append(b" ".join(parts).decode("utf-8"))
        arrays = [row, ids, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "kept", "n_words", "n_removed"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the other columns), ``id``, ``kept`` (words that stay, joined by one space), n_words and n_removed of every row."""
    on_workers(docs.sparkSession)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("body"), rest.alias("row"))
    known = own.where(F.col("id").isNotNull())
    # All joins are on the id and none is a broadcast, so the texts are dealt out once for the three of them.
    known = known.join(_copies(known).hint("merge"), "id", "left")
    known = known.withColumn("copy", F.when(F.array_contains("copies", F.xxhash64("body")), True))
    # All passes read the same columns (and the text under a new name, as an alias that changes nothing is dropped in
    # some places), or else the texts would be dealt out anew for each.
    by_anchor = known.select("id", "body", "copy", "row").mapInArrow(_anchor_rows, _ROWS.rpartition(",")[0])
    near = known.join(_by_id(by_anchor, False).hint("merge"), "id", "left").select("id", "body", "hits", "copy", "row").mapInArrow(_window_rows, _ROWS)
    hits = known.join(_by_id(near, True).hint("merge"), "id", "left").select("id", "body", "hits", "row", "copy")
    unknown = own.where(F.col("id").isNull()).select("id", "body", F.lit(None).cast("array<bigint>").alias("hits"), "row", F.lit(None).cast("boolean").alias("copy"))
    schema = f"row {own.schema['row'].dataType.simpleString()}, id bigint, kept string, n_words bigint, n_removed bigint"
    return hits.union(unknown).mapInArrow(_cleaned, schema)
