"""Masked pseudo-likelihood: every word is predicted from the words on both sides, and the log-probabilities add up.

Words (runs of other bytes than white space, A-Z lower-cased) are all counted, and the known ones numbered by how
frequent they are in all documents; the rest falls into ``buckets`` by hash. Both and the number of classes grow with the
square root of the number of distinct words. The network looks at two words before and two after: a table of vectors for each
of the four places, their sum through a tanh, and word classes in two steps: a softmax over groups of classes, and one
over the classes of a group. The most frequent words are a class of their own, the others share one with the words of their bucket. A word's probability is that of its class in its
context times its share of the class in the corpus; words of a bucket share its mass evenly.

Training, in numpy, goes over all documents in ``rounds`` disjoint parts. Every word of a document is masked once, so a
document's loss grows with its length. Each task trains on its own documents from the
weights of the last round; Spark averages the tasks' weights, in chunks, by the number of words that each saw. What a
round gathers grows with the input, and the driver only ever holds one model, which grows with the root of the vocabulary.

Null, empty and blank texts have no words: log-likelihood 0, no mean. A repeated row is scored twice alike; other columns
are not looked at. Words that are equally frequent are numbered by their hash. On an empty table there is nothing to
train on or to score, and the result is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.snapshots import cut
from .common import on_workers, pieces, utf8, word_hashes

PLACES = (-2, -1, 1, 2)
#: Weights of a row, when models are averaged.
_CHUNK = 4096
#: Known words are looked up by the bits of their hash above these.
_SLOT = np.uint64(46)


@dataclass
class Words:
    """Numbers of words: known ones by frequency, then buckets, then the mark for no word."""

    hashes: np.ndarray  # of known words, sorted
    number: np.ndarray  # of each of these
    classes: np.ndarray  # by number
    share: np.ndarray  # log of a number's share of its class
    buckets: int

    @property
    def size(self) -> int:
        return len(self.classes)

    @property
    def kinds(self) -> int:
        """The number of classes; the last bucket's is the last of them."""
        return int(self.classes[-1]) + 1

    def __post_init__(self):
        """A table that finds most known words by the first bits of their hash; those that share them are searched for."""
        slot = (self.hashes >> _SLOT).astype(np.int64)
        self.first = np.full(1 << 64 - int(_SLOT), -1, np.int32)
        self.first[slot] = np.arange(len(slot))
        self.late = np.flatnonzero(self.first[slot] != np.arange(len(slot)))
        self.crowded = np.zeros(len(self.first), bool)
        self.crowded[slot[self.late]] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + (hashes % np.uint64(self.buckets)).astype(np.int64)
        if not len(self.hashes):
            return out
        slot = (hashes >> _SLOT).astype(np.int64)
        at = self.first[slot]
        hit = (at >= 0) & (self.hashes[at] == hashes)
        out[hit] = self.number[at[hit]]
        rest = np.flatnonzero(self.crowded[slot] & ~hit)
        if len(rest):
            late = self.hashes[self.late]
            at = np.minimum(np.searchsorted(late, hashes[rest]), len(late) - 1)
            hit = late[at] == hashes[rest]
            out[rest[hit]] = self.number[self.late[at[hit]]]
        return out


def _counts(room: int):
    """A task's words and how often each occurs; what exceeds ``room`` is handed on in parts, so a word may come twice."""

    def run(batches):
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def table():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["hash", "n"])

        for batch in batches:
            for _, texts in pieces(utf8(t) for t in batch.column(0).to_pylist()):
                k, n = np.unique(word_hashes(texts, lower=True)[0], return_counts=True)
                k, n = np.concatenate([keys, k]), np.concatenate([times, n])
                order = np.argsort(k, kind="stable")
                k, n = k[order], n[order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                keys, times = k[first], np.add.reduceat(n, first) if len(first) else n
                if len(keys) > room:
                    yield table()
                    keys, times = keys[:0], times[:0]
        yield table()

    return run


def _bucket(buckets: int):
    """The hash, read as unsigned, modulo ``buckets``."""
    high, low = F.shiftrightunsigned("hash", 32), F.col("hash").bitwiseAND(F.lit((1 << 32) - 1))
    return F.pmod(high % buckets * ((1 << 32) % buckets) + low % buckets, F.lit(buckets))


def words(docs: DataFrame, text: str, known: int | None = None, alone: int | None = None, buckets: int | None = None, room: int = 400_000) -> Words:
    """Number the words of all documents; the ``alone`` most frequent ones are classes of their own.

    What isn't given grows with the square root of the number of distinct words.
    """
    on_workers(docs.sparkSession)
    lists = docs.select(F.col(text).cast("string")).mapInArrow(_counts(room), "hash bigint, n bigint")
    counted = cut(lists.groupBy("hash").agg(F.sum("n").alias("n")), "words")
    root = math.isqrt(counted.count())
    known = max(1000, 4 * root) if known is None else known
    alone = max(64, root // 4) if alone is None else alone
    buckets = max(64, root // 4) if buckets is None else buckets
    rows = counted.orderBy(F.desc("n"), "hash").limit(known).toArrow()
    # Of words that aren't known, one more that was never seen is reckoned with in each bucket.
    mass, distinct = np.ones(buckets), np.ones(buckets)
    for r in counted.groupBy(_bucket(buckets).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # one row a bucket
        mass[r["bucket"]] += r["n"]
        distinct[r["bucket"]] += r["words"]
    hashes = rows.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    n = rows.column("n").to_numpy().astype(float)
    of = (hashes % np.uint64(buckets)).astype(np.int64)
    mass -= np.bincount(of, n, buckets)
    distinct -= np.bincount(of, minlength=buckets)
    classes = np.concatenate([np.where(np.arange(len(n)) < alone, np.arange(len(n)), alone + of), alone + np.arange(buckets)])
    weight = np.concatenate([n, mass])
    share = np.log(weight / np.bincount(classes, weight, alone + buckets)[classes])
    share[len(n) :] -= np.log(distinct)  # a bucket's mass is that of all its words
    order = np.argsort(hashes)
    return Words(hashes[order], order, classes, share, buckets)


class Network:
    """Vectors for each place, a hidden layer, and classes in groups of about the root of their number.

    A class's probability is that of its group times its share of the group, each by a softmax of its own, so a target
    costs two short rows however many classes there are. All weights lie in one array.
    """

    def __init__(self, size: int, classes: int, width: int, weights: np.ndarray | None = None):
        self.members = max(1, math.isqrt(classes - 1) + 1)
        groups = -(-classes // self.members)
        self.width = width
        shapes = [(size + 1, len(PLACES) * width), (width, groups), (groups,), (groups, width, self.members), (groups, self.members)]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        if weights is None:
            weights = np.random.default_rng(29).normal(0, 0.1, ends[-1])
            weights[ends[2] : ends[3]] = weights[ends[4] :] = 0
            weights[ends[4] + classes :] = -1e9  # the last group's places beyond the classes
        self.weights = weights.astype(np.float32)
        self.place, self.group, self.group_bias, self.out, self.bias = (self.weights[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes))
        self.squares = [np.full(s, 1e-2, np.float32) for s in shapes]

    def hidden(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words at some places of a run of numbers, from what stands around them; two numbers frame the run."""
        vectors, inner, width = self.place[numbers], len(numbers) - 4, self.width
        total = vectors[2 + PLACES[0] : 2 + PLACES[0] + inner, :width].copy()
        for k, p in enumerate(PLACES[1:], 1):
            total += vectors[2 + p : 2 + p + inner, k * width : (k + 1) * width]
        total = total[at - 2]
        return np.tanh(total, out=total)

    def _groups(self, target: np.ndarray):
        """Targets in order of their groups: the order, the members, and (group, from, to) of those that occur."""
        group, member = np.divmod(target, self.members)
        order = np.argsort(group.astype(np.int16 if len(self.bias) < 1 << 15 else np.int64), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(self.bias) + 1)).tolist()
        return group, order, member[order], [(g, a, b) for g, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]

    def logs(self, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of the class that stands at each place."""

        def log_share(z: np.ndarray, is_it: np.ndarray) -> np.ndarray:
            z -= z.max(0)
            own = z[is_it, np.arange(z.shape[1])]
            return own - np.log(np.exp(z, out=z).sum(0))

        group, order, member, groups = self._groups(target)
        out = log_share(self.group.T @ hidden.T + self.group_bias[:, None], group)
        h, inner = hidden[order], np.empty(len(target), np.float32)
        for g, a, b in groups:
            inner[a:b] = log_share(self.out[g].T @ h[a:b].T + self.bias[g][:, None], member[a:b])
        out[order] += inner
        return out

    def step(self, numbers: np.ndarray, at: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean log-probability of the targets, which stand at some places of a run of numbers."""

        def slope(z: np.ndarray, is_it: np.ndarray) -> np.ndarray:
            z -= z.max(0)
            np.exp(z, out=z)
            z *= 1 / (z.sum(0) * len(target))
            z[is_it, np.arange(z.shape[1])] -= 1 / len(target)
            return z

        def change(k: int, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
            seen = self.squares[k][rows] + grad * grad
            self.squares[k][rows] = seen
            value[rows] -= rate * grad / np.sqrt(seen)

        h = self.hidden(numbers, at)
        group, order, member, groups = self._groups(target)
        d = slope(self.group.T @ h.T + self.group_bias[:, None], group)
        back = np.ascontiguousarray((self.group @ d).T)
        sorted_h, more = h[order], np.empty_like(h)
        for g, a, b in groups:
            z = slope(self.out[g].T @ sorted_h[a:b].T + self.bias[g][:, None], member[a:b])
            more[a:b] = (self.out[g] @ z).T
            change(3, self.out, (z @ sorted_h[a:b]).T, g)
            change(4, self.bias, z.sum(1), g)
        back[order] += more
        back *= 1 - h * h
        change(1, self.group, (d @ h).T)
        change(2, self.group_bias, d.sum(1))
        # Each number's vectors for all places at once: what comes back to a word from where it is seen.
        width = self.width
        every = np.zeros((len(numbers) + 4, width), np.float32)
        every[at + 2] = back
        order = np.argsort(numbers)
        rows = np.empty((len(numbers), len(PLACES) * width), np.float32)
        for k, p in enumerate(PLACES):
            rows[:, k * width : (k + 1) * width] = every[order + (2 - p)]
        n = numbers[order]
        first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        # Two numbers are added at once, as the parts of a complex one.
        change(0, self.place, np.add.reduceat(rows.view(np.complex64), first).view(np.float32), n[first])  # all other rows stay as they are


def _padded(numbers: np.ndarray, owner: np.ndarray, texts: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with two times ``none`` before, between and after the texts, and where each word stands."""
    padded = np.full(len(numbers) + 2 * (texts + 1), none, np.int32)
    at = (np.arange(len(numbers)) + 2 * owner + 2).astype(np.int32)
    padded[at] = numbers
    return padded, at


def _batches(padded: np.ndarray, at: np.ndarray, size: int):
    """(words from, to, the run of numbers around them, where they stand in it)."""
    for i in range(0, len(at), size):
        some = at[i : i + size]
        start = int(some[0]) - 2
        yield i, i + len(some), padded[start : int(some[-1]) + 3], some - start


def _trained(vocabulary, start, classes: int, width: int, rate: float, batch_size: int = 8192):
    def run(batches):
        w = vocabulary.value
        net = Network(w.size, classes, width, start.value)
        seen = 0
        for batch in batches:
            for _, texts in pieces(utf8(t) for t in batch.column(0).to_pylist()):
                hashes, owner = word_hashes(texts, lower=True)
                numbers = w.of(hashes)
                for a, b, run_of, at in _batches(*_padded(numbers, owner, len(texts), w.size), batch_size):
                    net.step(run_of, at, w.classes[numbers[a:b]], rate)
                seen += len(numbers)
        if seen:
            at = np.arange(0, len(net.weights), _CHUNK)
            parts = pa.array([net.weights[a : a + _CHUNK] for a in at], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(at // _CHUNK), pa.array(np.full(len(at), float(seen))), parts], names=["part", "seen", "weights"])

    return run


def _averaged(batches):
    """Weighted means of the parts, which come one after another: one part is held at a time, however many tasks trained."""
    part, total, weight = None, None, 0.0

    def mean():
        value = pa.array([(total / weight).astype(np.float32)], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), value], names=["part", "weights"])

    for batch in batches:
        for p, seen, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if p != part:
                if part is not None:
                    yield mean()
                part, total, weight = p, 0.0, 0.0
            total, weight = total + seen * weights.values.to_numpy().astype(float), weight + seen
    if part is not None:
        yield mean()


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rounds: int = 2, width: int = 24, rate: float = 0.1, alone: int | None = None, buckets: int | None = None):
    """(words, weights) of a network that every word of all documents has been a target of once."""
    spark = on_workers(docs.sparkSession)
    vocabulary = words(docs, text, alone=alone, buckets=buckets)
    shared = spark.sparkContext.broadcast(vocabulary)
    classes = vocabulary.kinds
    weights = Network(vocabulary.size, classes, width).weights
    turn = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(rounds))
    for k in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        some = docs.where(turn == k).select(F.col(text).cast("string"))
        parts = some.mapInArrow(_trained(shared, start, classes, width, rate / (k + 1)), "part bigint, seen double, weights array<float>")
        mean = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_averaged, "part bigint, weights array<float>")
        rows = mean.toArrow().sort_by("part")  # the model
        if rows.num_rows:
            weights = rows.column("weights").combine_chunks().flatten().to_numpy()
    return vocabulary, weights


def log_likelihoods(texts: list[bytes], w: Words, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Summed conditional log-probabilities of the words of every text, and the number of words."""
    total, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for start, some in pieces(texts):
        hashes, owner = word_hashes(some, lower=True)
        numbers = w.of(hashes)
        value = w.share[numbers]
        for a, b, run_of, at in _batches(*_padded(numbers, owner, len(some), w.size), 8192):
            value[a:b] += net.logs(net.hidden(run_of, at), w.classes[numbers[a:b]])
        total[start : start + len(some)] = np.bincount(owner, value, len(some))
        counts[start : start + len(some)] = np.bincount(owner, minlength=len(some))
    return total, counts


def scored(docs: DataFrame, model, id_col: str = "doc_id", text: str = "text", width: int = 24) -> DataFrame:
    """``id_col``, n_words, log_likelihood (a sum), mean_log_likelihood and perplexity of every row's whole text."""
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        w, weights = shared.value
        net = Network(w.size, w.kinds, width, weights)
        for batch in batches:
            total, counts = log_likelihoods([utf8(t) for t in batch.column(1).to_pylist()], w, net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(total)], names=[id_col, "n_words", "log_likelihood"])

    out = docs.select(id_col, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, log_likelihood double")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.withColumn("mean_log_likelihood", mean).withColumn("perplexity", F.exp(-mean))
