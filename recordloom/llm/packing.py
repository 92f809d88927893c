"""Packing by lexical retrieval: sequences of one length, filled with documents that share words.

1. Every text is tokenised once, into a written table; the same pass counts in how many documents each token occurs.
2. Documents are dealt to shards of about ``shard_tokens`` tokens by a hash of their place in that table, so neither ids
   nor texts can make one shard hot. In a shard, runs of a whole window's length are sequences of their own.
   What is left of each document goes into the shard's inverted index.
3. The index is BM25 over token ids, with document counts and lengths of the whole corpus. A seed piece asks with its
   weightiest tokens for unused pieces; the best ones fill its window, and one that doesn't fit is cut: its rest is the
   next seed. Pieces that share no token follow in their order.
4. What remains of a shard's last window is cut into sequences whose lengths are powers of two, so nothing is padded.

A null text is empty and has the end id only. Documents are told apart by their rows: rows that share an id are packed
each on its own, null ids like any other. Other columns are not looked at. An empty table gives no piece.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.snapshots import cut
from .common import kept_by_worker, on_workers, utf8
from .units import Vocabulary

#: BM25: how soon more of a token stops to count, and how much length counts.
K1, B = 1.2, 0.75
#: Tokens that a seed asks with.
ASKED = 24


def tokenised(docs: DataFrame, path: str, ranks: str, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (id, place, ids as bytes), and of (token, documents of this task that have it)."""
    on_workers(docs.sparkSession)
    key = f"ids:{uuid.uuid4().hex}"

    def run(batches):
        vocabulary = kept_by_worker(key, lambda: Vocabulary(path, ranks))
        narrow = len(vocabulary.starts) <= 1 << 16
        having = np.zeros(len(vocabulary.starts) + 1, np.int64)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for start in range(0, len(raw), 1000):
                out = []
                for ids in vocabulary.ids([utf8(t) for t in raw[start : start + 1000]]):
                    ids = np.append(ids, np.uint32(end))
                    having[np.unique(ids)] += 1
                    out.append(ids.astype("<u2" if narrow else "<u4").tobytes())
                n = len(out)
                arrays = [batch.column(0).slice(start, n), pa.array(np.arange(place, place + n)), pa.array(out, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
                place += n
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "place", "ids", "token", "documents"])
        at = np.flatnonzero(having)
        arrays = [pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(having[at])]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "place", "ids", "token", "documents"])

    schema = "id bigint, place bigint, ids binary, token bigint, documents bigint"
    return docs.select(F.col(id_col).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, schema)


class Index:
    """BM25 over the pieces of one shard; unused pieces are found by what a seed shares with them."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        tokens, of, times = [], [], []
        for k, ids in enumerate(pieces):
            t, n = np.unique(ids, return_counts=True)
            tokens.append(t)
            times.append(n)
            of.append(np.full(len(t), k))
        token, self.of, n = np.concatenate(tokens), np.concatenate(of), np.concatenate(times).astype(float)
        size = np.array([len(p) for p in pieces], float)
        weight = idf[token] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[self.of] / mean))
        # What a piece asks with: its own weightiest tokens.
        ends = np.cumsum([len(t) for t in tokens])
        self.asked = [t[np.argpartition(-w, min(ASKED, len(t)) - 1)[:ASKED]] if len(t) else t for t, w in zip(tokens, np.split(weight, ends[:-1]))]
        order = np.argsort(token, kind="stable")
        self.of, self.weight = self.of[order], weight[order]
        self.bounds = np.searchsorted(token[order], np.arange(len(idf) + 1))
        self.free = np.ones(len(pieces), bool)
        self.next = 0

    def take(self, k: int) -> None:
        self.free[k] = False

    def first(self) -> int | None:
        """The first unused piece."""
        while self.next < len(self.free) and not self.free[self.next]:
            self.next += 1
        return self.next if self.next < len(self.free) else None

    def neighbours(self, k: int):
        """Unused pieces, best score first, as long as they share a token that counts."""
        spans = [np.arange(self.bounds[t], self.bounds[t + 1]) for t in self.asked[k]]
        at = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        score = np.bincount(self.of[at], self.weight[at], len(self.free)) * self.free
        while score.any():
            best = int(score.argmax())
            score[best] = 0
            yield best


def packed_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard's documents."""
    out, sequence, tails = [], 0, []
    for k, ids in enumerate(docs):
        whole = len(ids) // length
        for w in range(whole):
            out.append((k, w * length, length, sequence, 0))
            sequence += 1
        if len(ids) % length:
            tails.append((k, whole * length))
    if not tails:
        return out
    index = Index([docs[k][start:] for k, start in tails], idf, mean)
    stream = []  # the tails in the order in which they follow each other
    room, seed = 0, None
    asked = iter(())
    while (piece := next(asked, None) if room else None) is not None or (piece := index.first()) is not None:
        index.take(piece)
        k, start = tails[piece]
        stream.append((k, start, len(docs[k]) - start))
        left = room - (len(docs[k]) - start)
        if left <= 0:  # the window is full: the cut piece, or the first that is left, is the next seed
            seed, room = piece, (left % length)
            asked = index.neighbours(piece) if room else iter(())
        else:
            room = left
            if seed is None:
                seed, asked = piece, index.neighbours(piece)
    total = sum(n for _, _, n in stream)
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]
    sizes = iter(sizes)
    left = offset = 0
    for k, start, n in stream:
        while n:
            if not left:
                left, offset = next(sizes), 0
                sequence += 1
            some = min(n, left)
            out.append((k, start, some, sequence - 1, offset))
            start, n, left, offset = start + some, n - some, left - some, offset + some
    return out


def packed(docs: DataFrame, path: str, ranks: str, length: int = 2048, end: int = 1, shard_tokens: int = 1_000_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence's pieces are its ids in order of ``offset``; ``tokenised`` has the ids themselves.
    """
    spark = docs.sparkSession
    rows = cut(tokenised(docs, path, ranks, end, id_col, text), "tokenised")
    texts = rows.where(F.col("place").isNotNull())
    having = rows.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("documents").alias("n")).collect()  # one row a token
    narrow = len(Vocabulary(path, ranks).starts) <= 1 << 16
    width = 2 if narrow else 4
    n, total = texts.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    total = (total or 0) // width
    idf = np.zeros(max([end, *(r["token"] for r in having)]) + 1)
    for r in having:
        idf[r["token"]] = np.log(1 + (n - r["n"] + 0.5) / (r["n"] + 0.5))
    idf[end] = 0.0
    shared = spark.sparkContext.broadcast(idf)
    shards, mean = max(1, -(-total // shard_tokens)), max(1.0, total / max(1, n))

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("place").combine_chunks()
        ids = [np.frombuffer(x.as_buffer(), "<u2" if narrow else "<u4") for x in shard.column("ids")]
        pieces = packed_shard(ids, shared.value, mean, length)
        base = (shard.column("shard")[0].as_py() << 32) if len(ids) else 0
        k = np.array([p[0] for p in pieces], np.int64)
        crc = [zlib.crc32(ids[d][a : a + m].astype("<u4").tobytes()) for d, a, m, _, _ in pieces]
        columns = [np.array([p[c] for p in pieces], np.int64) for c in (1, 2, 3, 4)]
        sizes = np.array([len(x) for x in ids], np.int64)
        arrays = [shard.column("id").take(pa.array(k)), *map(pa.array, (columns[0], columns[1], np.array(crc, np.int64), sizes[k], columns[2] + base, columns[3]))]
        return pa.Table.from_arrays(arrays, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    dealt = texts.select("id", "place", "ids", F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, ", ".join(f"`{c}` bigint" for c in names))
