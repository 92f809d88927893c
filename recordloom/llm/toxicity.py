"""Toxicity by subword-bag embeddings: character n-grams, averaged, into a linear softmax, trained together in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 characters with word marks, hashed to a fixed
number of rows), so a misspelt or inflected word that was never seen shares most of them. A bag is a run of ``window``
words of the text, repeated ones included, the mean of its words; two linear outputs and a softmax say how toxic it is. A text counts as toxic as its worst
bag, so length doesn't dilute it. In training, the bag of each text that scores highest stands for it and is chosen
anew in every step. A logistic curve fitted on training texts that the vectors haven't seen turns the best bag's margin into the score.

Null, empty and blank texts have no bag and get the score of a bag of no evidence. A repeated row is scored twice alike,
and of bags that score alike it doesn't matter which counts; rows without an id are scored but never learnt from; other
columns are not looked at. Without labels of both classes, as on empty tables, every score is 0.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, kept_by_worker, mixed, on_workers, pieces, span_hashes, utf8, words_of
from .labelled import calibrated, labelled_texts, logistic


@dataclass
class Settings:
    buckets: int = 1 << 16
    width: int = 12
    window: int = 12
    epochs: int = 80
    rate: float = 0.05
    decay: float = 3e-5
    focus: float = 6.0
    unknown: float = 0.3
    least_texts: int = 5
    seed: int = 5


_STRIP = " \t\n\v\f\r.,;:!?\"'()[]{}<>*#$%&|_-"


#: Words of more characters are hashed in parts, and have no row of their own beside those of their n-grams.
_PART = 1 << 16
#: Words whose n-grams are hashed at once.
_AT_ONCE = 20_000


def _rows_of(marked: list[str], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and row of all n-grams, sorted, each pair once."""
    data = np.frombuffer("".join(marked).encode("utf-8", "replace"), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes where characters begin
    size = np.array([len(w) for w in marked], np.int64)
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(marked)), size)
    found = [(np.arange(len(marked)), at[end - size], at[end])] if whole else []
    place = np.arange(len(word))
    for n in (3, 4, 5):
        some = place[place + n <= end[word]]
        found.append((word[some], at[some], at[some + n]))
    pairs = [w * buckets + (mixed(span_hashes(data, a, b) + (b - a).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) for w, a, b in found]
    pairs = distinct(np.concatenate(pairs))
    return pairs // buckets, pairs % buckets


def grams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of 3 to 5 characters of each word, and of the word itself, all in one array; where each word's begin."""
    lowered = b"\n".join(words).decode("utf-8", "replace").lower().split("\n") if words else []
    marked = [f"<{w.strip(_STRIP)}>" for w in lowered]
    rows, sizes, k = [np.zeros(0, np.int64)], np.zeros(len(words), np.int64), 0
    while k < len(marked):
        if len(marked[k]) > _PART:
            parts = (marked[k][i : i + _PART + 4] for i in range(0, len(marked[k]) - 4, _PART))
            own = np.unique(np.concatenate([_rows_of([p], buckets, False)[1] for p in parts]))
            to, sizes[k] = k + 1, len(own)
        else:
            to, length = k, 0
            while to < len(marked) and to - k < _AT_ONCE and len(marked[to]) <= _PART and length < 1 << 20:
                length, to = length + len(marked[to]), to + 1
            of, own = _rows_of(marked[k:to], buckets, True)
            sizes[k:to] = np.bincount(of, minlength=to - k)
        rows.append(own)
        k = to
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)])


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries in one array, and where each list begins."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _bags(n: int, window: int) -> list[tuple[int, int]]:
    """Overlapping runs of words that cover a text of n words."""
    if n <= window:
        return [(0, n)] if n else []
    step = window // 2
    last = list(range(0, n - window + 1, step))
    if last[-1] != n - window:
        last.append(n - window)
    return [(i, i + window) for i in last]


@dataclass
class Model:
    """What scoring needs: the margin that each n-gram's row adds, the curve, and the size of a bag."""

    rows: np.ndarray  # float64[buckets]: vector times (toxic weight - other weight)
    bias: float
    curve: tuple[float, float]
    window: int
    key: str = ""


def fit(sample: list[tuple[bytes, int]], s: Settings | None = None) -> Model:
    """Train vectors and softmax jointly; Adam on whole-sample gradients."""
    s = s or Settings()
    if len({y for _, y in sample}) < 2:
        return Model(np.zeros(s.buckets), 0.0, (0.0, -40.0), s.window, "none")
    rng = np.random.default_rng(s.seed)
    # Every fourth text of either class is left for the curve.
    seen = {0: 0, 1: 0}
    part = []
    for _, y in sample:
        part.append(seen[y] % 4 == 3)
        seen[y] += 1
    part = np.array(part)
    y = np.array([y for _, y in sample], float)
    words: dict[bytes, int] = {}
    docs = [[words.setdefault(w, len(words)) for w in text.split()] for text, _ in sample]
    grams_of, at = grams(list(words), s.buckets)
    # Rows that few texts have can only be learnt by heart; they stay zero.
    texts_with = np.zeros(s.buckets, np.int64)
    for d, own in zip(docs, part):
        if d and not own:
            texts_with[distinct(np.concatenate([grams_of[at[w] : at[w + 1]] for w in set(d)]))] += 1
    known = texts_with >= s.least_texts
    per_word = 1.0 / np.diff(at)
    word_of = np.repeat(np.arange(len(words)), np.diff(at))[known[grams_of]]
    grams_of = grams_of[known[grams_of]]
    flat, doc_at = _ragged(docs)
    spans = [(doc_at[i] + a, doc_at[i] + b, i) for i, d in enumerate(docs) for a, b in _bags(len(d), s.window)]
    lo, hi, owner = (np.array(c, np.int64) for c in zip(*spans))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    repeats = np.diff(np.append(first, len(lo)))

    vectors = rng.normal(0, 0.1, (s.buckets, s.width)) * known[:, None]
    out = rng.normal(0, 0.1, (s.width, 2))
    bias = np.zeros(2)
    moment = [[np.zeros_like(v), np.zeros_like(v)] for v in (vectors, out, bias)]

    def margins(rows: np.ndarray) -> np.ndarray:
        """Of all bags, by the margin of every n-gram."""
        word = np.bincount(word_of, rows[grams_of], len(words)) * per_word
        total = np.concatenate([[0.0], np.cumsum(word[flat])])
        return (total[hi] - total[lo]) / (hi - lo)

    weight = np.where(y == 1, 0.5 / max(1, ((y == 1) & ~part).sum()), 0.5 / max(1, ((y == 0) & ~part).sum()))
    weight = np.where(part, 0.0, weight)[owner[first]]
    for epoch in range(1, s.epochs + 1):
        rows = vectors @ (out[:, 1] - out[:, 0])
        m = margins(rows) + bias[1] - bias[0]
        # At first all bags of a text speak for it alike, then more and more its highest one.
        share = np.exp(np.minimum(s.focus * epoch / s.epochs, s.focus) * (m - np.repeat(np.maximum.reduceat(m, first), repeats)))
        share /= np.repeat(np.add.reduceat(share, first), repeats)
        loss = weight * (logistic(np.add.reduceat(share * m, first)) - y[owner[first]])  # its slope, by the text's margin
        g = np.repeat(loss, repeats) * share
        change = np.zeros(len(flat) + 1)
        np.add.at(change, lo, g / (hi - lo))
        np.add.at(change, hi, -g / (hi - lo))
        word = np.bincount(flat, np.cumsum(change)[:-1], len(words)) * per_word
        row = np.bincount(grams_of, word[word_of], s.buckets)
        side = row @ vectors
        # A bag of nothing that is known isn't toxic.
        slope = loss.sum() + s.unknown * logistic(bias[1] - bias[0])
        diff = out[:, 1] - out[:, 0]
        grads = (np.outer(row, diff) + s.decay * vectors, np.column_stack([-side, side]) + 1e-4 * out, np.array([-slope, slope]))
        for value, grad, (m1, m2) in zip((vectors, out, bias), grads, moment):
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad * grad
            value -= s.rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-7)
    rows, b = vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])
    m = np.maximum.reduceat(margins(rows), first) + b
    texts = owner[first]
    own = part[texts]
    curve = calibrated(np.append(m[own], b)[:, None], np.append(y[texts[own]], 0.0), np.append(np.ones(own.sum()), s.unknown * own.sum()), ridge=0.05)
    curve = (float(curve[0]), float(curve[1])) if curve[0] > 0 else (1.0, 0.0)
    model = Model(rows, b, curve, s.window)
    model.key = hashlib.sha256(rows.tobytes() + repr((b, curve)).encode()).hexdigest()[:16]
    return model


class Scorer:
    """Scores texts; the margins of words are looked up by hash in a table of a fixed size, in which later words replace earlier ones."""

    def __init__(self, model: Model, bits: int = 20):
        self.model, self.bits = model, np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        self.lowest = float(logistic(model.curve[0] * model.bias + model.curve[1])) if model.key != "none" else 0.0

    def words(self, words: list[bytes]) -> np.ndarray:
        """The margin of each word: the mean over its n-grams."""
        rows, at = grams(words, len(self.model.rows))
        return np.add.reduceat(self.model.rows[rows], at[:-1]) / np.diff(at) if len(words) else np.zeros(0)

    def margins(self, joined: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The margin of every word of some texts; each distinct one that the table lacks is worked out once."""
        slot = (hashes >> self.bits).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != hashes)
        fresh, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
        first = miss[first]
        values = np.empty(len(fresh))
        for k in range(0, len(fresh), _AT_ONCE):
            some = first[k : k + _AT_ONCE]
            values[k : k + _AT_ONCE] = self.words([joined[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])
        out[miss] = values[back]
        # Where two words want one slot, the last of them gets it, key and value alike.
        _, last = np.unique((fresh >> self.bits)[::-1], return_index=True)
        last = len(fresh) - 1 - last
        slot = (fresh[last] >> self.bits).astype(np.int64)
        self.keys[slot], self.values[slot] = fresh[last], values[last]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of every text, by its worst bag; equal texts score alike wherever they stand."""
        out = np.full(len(texts), self.lowest)
        if self.model.key == "none":
            return out
        for start, some in pieces(texts):
            joined, starts, ends, hashes, owner = words_of(some)
            values = self.margins(joined, starts, ends, hashes)
            n = np.bincount(owner, minlength=len(some))
            best = self._worst(values, np.cumsum(n) - n, n)
            known = n > 0
            out[start : start + len(some)][known] = logistic(self.model.curve[0] * (best[known] + self.model.bias) + self.model.curve[1])
        return out

    def _worst(self, values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest mean of a bag, of texts whose ``n`` words begin at ``first``."""
        window, step = self.model.window, self.model.window // 2
        best = np.full(len(n), -np.inf)
        for k in np.array_split(np.flatnonzero((n > 0) & (n <= window)), 1 + len(n) // 50_000):
            place = np.minimum(np.arange(window), n[k, None] - 1)
            best[k] = np.where(np.arange(window) < n[k, None], values[first[k, None] + place], 0.0).sum(1) / n[k]
        long = np.flatnonzero(n > window)
        bags = (n[long] - window + step - 1) // step + 1
        begin = np.cumsum(bags) - bags
        place = np.arange(bags.sum()) - np.repeat(begin, bags)
        at = np.repeat(first[long], bags) + np.minimum(place * step, np.repeat(n[long] - window, bags))
        means = np.empty(len(at))
        for k in range(0, len(at), 100_000):
            means[k : k + 100_000] = values[at[k : k + 100_000, None] + np.arange(window)].sum(1) / window
        if len(long):
            best[long] = np.maximum.reduceat(means, begin)
        return best


def train(docs: DataFrame, labels: DataFrame, train_rows, per_class: int = 2000, max_bytes: int = 10_000, settings: Settings | None = None) -> Model:
    """Fit on a bounded sample: at most ``per_class`` texts of either class of at most ``max_bytes`` bytes each."""
    return fit(labelled_texts(docs, labels, "toxic", train_rows, per_class, max_bytes), settings)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", into: str = "score") -> DataFrame:
    """The frame with a toxicity score from 0 to 1 of every row's whole text."""
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(into)).schema

    def run(batches):
        m = shared.value
        scorer = kept_by_worker(f"toxicity:{m.key}", lambda: Scorer(m))
        for batch in batches:
            texts = [utf8(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.scores(texts), pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)
