"""Document quality by a linear-chain conditional random field over lines.

Every line with a visible character is good or bad. Its features are shares of character classes, length, word length
and repetition, of the line itself and of the lines before and after it; a transition matrix couples neighbouring
labels. Training maximises the conditional likelihood of line labels in numpy. Labels exist for documents only: all
lines of a document first get its label, then lines of bad documents that the field holds for good are relabelled and
the field is fitted again, so that a document of both kinds teaches both. A document's quality is the mean of its
lines' forward-backward marginals weighted by line length, which a logistic curve turns into the score.

Documents without a visible character (null, empty, blank) have no line and get score 0. A repeated row is scored
twice alike; other columns are not looked at. Without labels of both classes every score is the share of good labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, pieces, utf8
from .labelled import calibrated, labelled_texts, logistic

#: Character classes by byte: upper, lower, digit, gap, . , ; : ' ", other ASCII marks one class for each group, bytes beyond ASCII.
_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\v\f\r", ".,;:'\"?-()", "!", "|", "#*$%&", "<>=/\\{}[]_@~^`+"]
_CLASS = np.zeros(256, np.int64)
for _i, _g in enumerate(_GROUPS, 1):
    _CLASS[[ord(c) for c in _g]] = _i
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
#: Of the line: shares of the classes, their square roots, length, letters per gap, repeats of the text's earlier lines and words.
_OWN = 2 * _CLASSES + 5


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bytes and text position of every line that has a visible character."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = np.repeat(np.arange(len(ends)), ends - starts + 1)
    counts = np.bincount(line * _CLASSES + _CLASS[data], minlength=len(ends) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    counts[:, 0] -= 1  # the line feed
    size = ends - starts
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(offsets, starts, "right") - 1
    seen = counts.sum(1) - counts[:, 4] > 0
    share = counts[seen] / np.maximum(size[seen], 1)[:, None]
    # A line that its text has had before; words that follow themselves.
    buffer = data.tobytes()
    again, same = np.zeros(seen.sum()), np.zeros(seen.sum())
    last, had = -1, set()
    for k, (a, b, o) in enumerate(zip(starts[seen].tolist(), ends[seen].tolist(), owner[seen].tolist())):
        if o != last:
            last, had = o, set()
        text = buffer[a:b]
        again[k] = text in had
        had.add(text)
        words = text.split()
        same[k] = 1.0 - len(set(words)) / len(words) if len(words) > 1 else 0.0
    letters = share[:, 1] + share[:, 2] + share[:, _CLASSES - 1]
    own = np.column_stack([share, np.sqrt(np.maximum(share, 0)), np.log1p(size[seen]) / 5, np.minimum(letters / (share[:, 4] + 0.02), 50) / 10, again, same, same * same])
    return own, size[seen], owner[seen]


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines around it in its text, and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    edge = np.zeros((n, 2))
    if n:
        same = owner[1:] == owner[:-1]
        before[1:][same] = own[:-1][same]
        after[:-1][same] = own[1:][same]
        edge[0, 0] = edge[-1, 1] = 1
        edge[1:, 0] = ~same
        edge[:-1, 1] = ~same
    return np.column_stack([own, before, after, edge, np.ones(n)])


@dataclass
class Model:
    weights: np.ndarray  # features: how much better than bad
    transitions: np.ndarray  # 2 x 2, of bad and good
    mean: np.ndarray
    spread: np.ndarray
    curve: tuple
    constant: float | None = None


def _chains(owner: np.ndarray) -> list[np.ndarray]:
    """Lines by their place in their text: all first lines, all second ones; texts with more lines come first."""
    if not len(owner):
        return []
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, len(owner)))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    return [first[:k] + t for t, k in enumerate(active)]


def _norm(a: np.ndarray) -> np.ndarray:
    top = a.max(-1, keepdims=True)
    return top + np.log(np.exp(a - top).sum(-1, keepdims=True))


def marginals(score: np.ndarray, transitions: np.ndarray, chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for every line, and the expected transitions, by the forward-backward recursions."""
    n = len(score)
    emit = np.column_stack([np.zeros(n), score])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for t, at in enumerate(chains):
        if t:
            prev = forward[chains[t - 1][: len(at)]]
            step = emit[at] + _norm(np.swapaxes(prev[:, :, None] + transitions, 1, 2))[..., 0]
        else:
            step = emit[at]
        forward[at] = step - _norm(step)
    pairs = np.zeros((2, 2))
    for t in range(len(chains) - 1, 0, -1):
        at = chains[t]
        prev = chains[t - 1][: len(at)]
        inner = transitions + (emit[at] + backward[at])[:, None, :]
        joint = forward[prev][:, :, None] + inner
        joint = joint.reshape(len(at), 4)
        pairs += np.exp(joint - _norm(joint)).sum(0).reshape(2, 2)
        back = _norm(inner)[..., 0]
        backward[prev] = back - _norm(back)
    both = forward + backward
    return np.exp(both - _norm(both))[:, 1], pairs


def _train(x, y, owner, weight, chains, steps: int, rate: float, ridge: float, start=None):
    """Gradient ascent (Adam) on the conditional log-likelihood of the labels y; each document counts once."""
    w, tr = (np.zeros(x.shape[1]), np.zeros((2, 2))) if start is None else start
    observed = np.zeros((2, 2))
    for t in range(1, len(chains)):
        at, prev = chains[t], chains[t - 1][: len(chains[t])]
        np.add.at(observed, (y[prev], y[at]), 1.0)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    total, links = weight.sum(), max(1.0, observed.sum())
    for k in range(1, steps + 1):
        p, pairs = marginals(x @ w, tr, chains)
        grads = x.T @ (weight * (y - p)) / total - ridge * w, (observed - pairs) / links - ridge * tr
        for value, grad, m1, m2 in ((w, grads[0], moments[0], moments[1]), (tr, grads[1], moments[2], moments[3])):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            value += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return w, tr


def _quality(p: np.ndarray, size: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 without a line."""
    return np.bincount(owner, p * size, texts) / np.maximum(np.bincount(owner, size, texts), 1)


def fit(sample: list[tuple[bytes, int]], steps: int = 120, rate: float = 0.08, ridge: float = 1e-4, most_lines: int = 300_000) -> Model:
    """Fit on the whole texts of a bounded sample: of either class, those that fit into ``most_lines`` lines, in their order."""
    room, whole = {0: most_lines, 1: most_lines}, []
    for t, y in sample:
        lines = t.count(b"\n") + 1
        if lines <= room[y]:
            room[y] -= lines
            whole.append((t, y))
    sample = whole
    good = [y for _, y in sample]
    if len(set(good)) < 2:
        return Model(np.zeros(0), np.zeros((2, 2)), np.zeros(0), np.ones(0), (), float(np.mean(good)) if good else 1.0)
    texts = [t for t, _ in sample]
    label = np.array(good)
    own, size, owner = line_features(texts)
    x = with_neighbours(own, owner)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    mean[-1], spread[-1] = 0, 1
    x = np.clip((x - mean) / spread, -6, 6)
    chains = _chains(owner)
    y = label[owner]
    lines = np.bincount(owner, minlength=len(texts))
    weight = (np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) / np.maximum(lines, 1))[owner]
    w, tr = _train(x, y, owner, weight, chains, steps, rate, ridge)
    for _ in range(2):
        p, _ = marginals(x @ w, tr, chains)
        # The worst line of a bad document stays bad.
        worst = np.full(len(texts), np.inf)
        np.minimum.at(worst, owner, p)
        y = np.where(label[owner] == 1, 1, ((p > 0.5) & (p > worst[owner])).astype(int))
        w, tr = _train(x, y, owner, weight, chains, steps // 2, rate / 2, ridge, (w, tr))
    p, _ = marginals(x @ w, tr, chains)
    curve = calibrated(_quality(p, size, owner, len(texts))[lines > 0, None], label[lines > 0], np.ones((lines > 0).sum()), ridge=1e-3)
    return Model(w, tr, mean, spread, tuple(curve))


def line_marginals(texts: list[bytes], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good, bytes and text position of every line with a visible character."""
    own, size, owner = line_features(texts)
    x = np.clip((with_neighbours(own, owner) - m.mean) / m.spread, -6, 6)
    p, _ = marginals(x @ m.weights, m.transitions, _chains(owner))
    return p, size, owner


def scores(texts: list[bytes], m: Model) -> np.ndarray:
    if m.constant is not None:
        return np.array([m.constant if t.split() else 0.0 for t in texts])
    out = np.zeros(len(texts))
    for start, some in pieces(texts):
        p, size, owner = line_marginals(some, m)
        lines = np.bincount(owner, minlength=len(some)) > 0
        value = logistic(m.curve[0] * _quality(p, size, owner, len(some)) + m.curve[1])
        out[start : start + len(some)] = np.where(lines, value, 0.0)
    return out


def train(docs: DataFrame, labels: DataFrame, train_rows, per_class: int = 1500, max_bytes: int = 20_000) -> Model:
    """Fit on a bounded sample: at most ``per_class`` texts of either class of at most ``max_bytes`` bytes each."""
    return fit(labelled_texts(docs, labels, "quality", train_rows, per_class, max_bytes))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The frame with a quality score from 0 to 1 of every row's whole text."""
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(into)).schema

    def run(batches):
        for batch in batches:
            texts = [utf8(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(texts, shared.value), pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)
