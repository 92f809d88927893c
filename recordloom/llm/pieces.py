"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k without replacement.

``encoded`` and ``decoded`` are the library's own, over frames, and ``round_trip`` is by the library. ``sampled`` draws, for every row, distinct segmentations of its whole
text, as if all segmentations had been given Gumbel noise and the k highest were taken. A text's lattice has too many
paths for that, so an A-star search goes through regions of it, from the top down: a region's highest perturbed score
is drawn first, as one Gumbel variable at the log of the region's mass, and when the region is split, one part inherits
it and the others get scores truncated at it. These scores are exact bounds, so the search emits segmentations in the order of their
perturbed scores and never one twice. What is next in the queue after k of them is the threshold of the inclusion
scores: a segmentation of log-probability l has been included with probability 1 - exp(-exp(l - threshold)).

No piece crosses a word mark, so the lattice falls into units (a word with its mark). Splitting goes unit by unit: the
path drawn for a unit against all its other paths. A worker keeps the lattices of units, as arrays, with the library's best encoding of
each, until they are too many; those that a piece of text adds are built together, and all its units are walked along
them at the same time. Noise is a hash of the row's key, the number of the sample and the place in the text.

A piece's probability falls with its place in the vocabulary (Zipf's law), as the merge ranks of such a model are no
probabilities. A character without a piece is spelt in byte pieces. Null texts are empty, and an empty text has one segmentation, of no
pieces. Rows that share a key and a text get the same samples; a null key is a key. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, _SPREAD, kept_by_worker, mixed, on_workers
from .units import Table

MARK = "▁"
_MARK = MARK.encode()
#: Texts are worked on in runs of about so many bytes.
_RUN = 1 << 18
#: Lattices are kept until they have so many edges (of 24 bytes), and are looked up in a table of 2 to the power of so many slots.
_KEPT, _SLOTS = 7_000_000, 21
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a number between 0 and 1 by which an edge is drawn; the node's number stands above them.
_FINE = 40
_ALL = (1 << 64) - 1
#: More than the edges of any node.
_SPARE = 1 << 10


def _stem(key, sample: int, kind: int = 0) -> np.ndarray:
    """What the noise of a row's key and a sample has in common."""
    return mixed(np.atleast_1d(np.asarray(key, np.uint64)) + np.array([2 * sample + kind + 1], np.uint64) * _C1)


def _noise(stem: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(stem + place * _C2)


def _unit_interval(x):
    """Numbers between 0 and 1 (neither of both) from noise."""
    return ((x >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def _mixed_one(x: int) -> int:
    x &= _ALL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def uniform(key: int, sample: int, place: int, kind: int = 0) -> float:
    """A number between 0 and 1 (neither of both) for a row's key, a sample and a place in the text: as by ``_noise``, many times quicker for one."""
    stem = _mixed_one(key + (2 * sample + kind + 1) * int(_C1))
    return ((_mixed_one(stem + place * int(_C2)) >> 12) + 0.5) / 2.0**52


def _truncated(mass: float, bound: float, u: float) -> float:
    """A Gumbel variable at ``mass``, given that it isn't above ``bound``."""
    return mass - math.log(math.exp(mass - bound) - math.log(u))


def _rest(logp) -> np.ndarray:
    """Log of the mass that is beside a path; none where rounding is all that is left."""
    p = np.exp(logp)
    with np.errstate(divide="ignore"):
        return np.where(p < 1 - 1e-12, np.log1p(-np.minimum(p, 1.0)), -np.inf)


class Model:
    """A sentencepiece model: the library, logits of its pieces, and their hashes."""

    def __init__(self, path: str, best: bool = False):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        weight = -np.log(np.arange(n) + 2.7)
        self.logit = weight - np.log(np.exp(weight).sum())
        self.byte = np.full(256, max(self.library.unk_id(), 0), np.int64)  # without byte pieces: the unknown piece
        self.byte_logit, self.surface, pieces, ids = float(self.logit[-1]), [b""] * n, [], []
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                self.surface[i] = piece.replace(MARK, " ").encode()
                pieces.append(piece.encode())
                ids.append(i)
        self.longest = max(map(len, pieces))
        self.size = np.array([len(x) for x in self.surface])
        # All beginnings of pieces, so that a search can stop early: id -2 if one isn't a piece itself.
        known = {p[:n]: -2 for p in pieces for n in range(1, len(p))} | dict(zip(pieces, ids))
        ends = np.cumsum([len(p) for p in known])
        hashes = _spans(np.frombuffer(b"".join(known), np.uint8))(ends - [len(p) for p in known], ends)
        values = np.array([*known.values()], np.int32)
        # Two tables: what finds its slot taken in the first goes to the second, which is sorted.
        self.bits = 18
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.keys[slot] = hashes
        held = self.keys[slot] == hashes
        self.values[slot[held]] = values[held]
        late = np.flatnonzero(~held)
        late = late[np.argsort(hashes[late])]
        self.late, self.late_ids = np.append(hashes[late], np.uint64(2**64 - 1)), np.append(values[late], np.int32(-1))
        self.maybe = np.zeros(1 << self.bits, bool)  # by their last bits, which can be there
        self.maybe[self._low(hashes[late])] = True
        self.lattices = Lattices(self, best)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, -2 for what only begins one, else -1."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.values[slot], -1)
        rest = np.flatnonzero((out == -1) & self.maybe[self._low(hashes)])
        at = np.searchsorted(self.late, hashes[rest])
        out[rest] = np.where(self.late[np.minimum(at, len(self.late) - 1)] == hashes[rest], self.late_ids[np.minimum(at, len(self.late) - 1)], -1)
        return out

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decoded(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)

    def spelt(self, ids) -> bytes:
        """The text of a segmentation: its pieces' surfaces without the mark that was put before the first."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]


def _spans(data: np.ndarray):
    """A function that hashes spans of bytes."""
    up, down = _SPREAD[1](len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[1][data] * up[: len(data)], out=total[1:])
    return lambda a, b: mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _marks(data: np.ndarray) -> np.ndarray:
    """Whether a mark begins at a byte."""
    mark, n = np.zeros(len(data), bool), len(data)
    mark[: n - 2] = (data[: n - 2] == _MARK[0]) & (data[1 : n - 1] == _MARK[1]) & (data[2:] == _MARK[2])
    return mark


def _units(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at each mark that stands after something else."""
    n = len(data)
    mark = _marks(data)
    after = np.zeros(n, bool)
    after[3:] = mark[: n - 3]
    first = mark & ~after
    first[starts] = True
    return np.flatnonzero(first)


class _Pool:
    """An array that grows at its end; after it, the highest number (if it is of integers of 64 bits)."""

    def __init__(self, kind, *first):
        self.room, self.used = np.empty(_KEPT + _KEPT // 4, kind), 0
        self.end = np.iinfo(kind).max if kind is np.int64 else 0
        self.add(np.array(first, kind))

    def add(self, new: np.ndarray) -> None:
        used = self.used + len(new)
        if used + _SPARE > len(self.room):
            self.room = np.concatenate([self.room[: self.used], np.empty(used - self.used + used // 4 + _SPARE, self.room.dtype)])
        self.room[self.used : used] = new
        self.room[used : used + _SPARE] = self.end
        self.used = used

    def reset(self, ends: np.ndarray) -> None:
        """Let these be all bounds."""
        self.used = 0
        self.add(np.append(0, ends))

    def keep(self, at: np.ndarray) -> np.ndarray:
        """Let some entries be all, and give a view of them."""
        some = self.room[at]
        if len(self.room) > 2 * _KEPT:  # one text was very long
            self.room = np.empty(_KEPT + _KEPT // 4, self.room.dtype)
        self.used = 0
        self.add(some)
        return self.all

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.used]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Lattices:
    """Lattices of units, as arrays to which more units are added: nodes (characters) by their unit, edges by their node.

    With ``best``, the ids of the library's best encoding of each unit as well.
    """

    def __init__(self, model: Model, best: bool):
        self.model, self.with_best = model, best
        self.table = Table.empty(_SLOTS)
        self.hash, self.seen = _Pool(np.uint64), _Pool(np.int64)  # of a unit: its hash, how often it came up
        self.first = _Pool(np.int64, 0)  # of a unit, its first node; of the one after the last, where nodes end
        self.bounds = _Pool(np.int64, 0)  # of a node, its first edge, likewise
        self.at, self.width = _Pool(np.int64), _Pool(np.int32)  # of a node's character, in the units' bytes
        self.data, self.data_bounds = _Pool(np.uint8), _Pool(np.int64, 0)
        self.target, self.ident = _Pool(np.int32), _Pool(np.int32)
        self.logp, self.cdf = _Pool(float), _Pool(np.int64)
        self.best, self.best_bounds = _Pool(np.int32), _Pool(np.int64, 0)
        self.odd = _Pool(bool)  # units whose best encoding the library doesn't give by themselves

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of every unit of some data; those not known yet are added."""
        if self.target.used > _KEPT:
            self._trim()
        hashes = _spans(data)(begin, end)
        hit, out, _ = self.table.find(hashes)
        out = out.astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            fresh, rep, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            out[miss] = self.hash.used + back
            self._learn(fresh)
            size = (end - begin)[miss[rep]]
            self._add(data[_ranges(begin[miss[rep]], size)], size)
        self.seen.all[:] += np.bincount(out, minlength=self.seen.used)
        return out

    def _learn(self, hashes: np.ndarray) -> None:
        self.table.put(hashes, (self.hash.used + np.arange(len(hashes))).astype(np.int32), np.zeros(len(hashes), np.int32))
        self.hash.add(hashes)
        self.seen.add(np.zeros(len(hashes), np.int64))

    def _trim(self) -> None:
        """Keep the units that came up most often, as far as they fill half the room."""
        first, bounds, seen = self.first.all, self.bounds.all, self.seen.all
        edges = np.diff(bounds[first])
        by = np.argsort(-seen, kind="stable")
        by = by[(seen[by] > 1) & (edges[by] < _KEPT >> 8)]
        keep = np.sort(by[np.cumsum(edges[by]) <= _KEPT // 2])
        nodes, sizes = np.diff(first)[keep], np.diff(self.data_bounds.all)[keep]
        node, shift = _ranges(first[keep], nodes), np.cumsum(nodes) - nodes - first[keep]  # of a unit's nodes
        edges = np.diff(bounds)[node]
        edge, shift = _ranges(bounds[node], edges), np.repeat(np.repeat(shift, nodes), edges)
        target = self.target.keep(edge)
        target[:] = np.where(target >= 0, target + shift, -1)
        self.cdf.keep(edge)[:] += shift << _FINE
        del shift
        self.ident.keep(edge)
        self.logp.keep(edge)
        self.at.keep(node)[:] += np.repeat(np.cumsum(sizes) - sizes - self.data_bounds.all[keep], nodes)
        self.width.keep(node)
        self.data.keep(_ranges(self.data_bounds.all[keep], sizes))
        if self.with_best:
            many = np.diff(self.best_bounds.all)[keep]
            self.best.keep(_ranges(self.best_bounds.all[keep], many))
            self.best_bounds.reset(np.cumsum(many))
            self.odd.keep(keep)
        self.first.reset(np.cumsum(nodes))
        self.bounds.reset(np.cumsum(edges))
        self.data_bounds.reset(np.cumsum(sizes))
        kept, seen = self.hash.room[keep], seen[keep] // 2  # what came up long ago counts less
        self.hash.used = self.seen.used = 0
        self.table.keys[:] = 0
        self._learn(kept)
        self.seen.all[:] = seen

    def _add(self, data: np.ndarray, size: np.ndarray) -> None:
        """Add units: their bytes, one unit after another, and how many each has."""
        model, end = self.model, np.cumsum(size)
        begins = (data & 0xC0) != 0x80  # of a character
        at = np.flatnonzero(begins)
        place = np.cumsum(begins) - 1  # of a byte that begins a character, its number
        unit = np.repeat(np.arange(len(size)), size)[at]
        per_unit = np.bincount(unit, minlength=len(size))
        last = np.cumsum(per_unit)[unit]
        left = last - np.arange(len(at))
        stop = end[unit]
        width = np.append(at[1:], stop[-1:]) - at  # of the character
        width = np.where(left == 1, stop - at, width)
        hashed = _spans(data)
        many = np.zeros(len(at), np.int64)  # edges of a node
        # Of edges: their node, how many it has before them, where they lead to, the piece.
        found: list[tuple] = []
        alive = np.arange(len(at))
        for n in range(1, model.longest + 1):
            alive = alive[at[alive] + n <= stop[alive]]
            if not len(alive):
                break
            goes = at[alive] + n
            ident = model.find(hashed(at[alive], goes))
            hit = np.flatnonzero(ident >= 0)
            source, goes = alive[hit], goes[hit]
            found.append((source, many[source], np.where(goes == stop[source], -1, place[np.minimum(goes, len(data) - 1)]), ident[hit]))
            many[source] += 1
            alive = alive[ident != -1]
        # Characters without a piece are spelt in bytes: id -1.
        spelt = np.ones(len(at), bool)
        for source, _, target, _ in found:
            spelt[source[np.where(target >= 0, target, last[source]) - source == 1]] = False
        spelt = np.flatnonzero(spelt)
        found.append((spelt, many[spelt], np.where(left[spelt] == 1, -1, spelt + 1), np.full(len(spelt), -1)))
        many[spelt] += 1
        ends = np.cumsum(many)
        bounds = ends - many
        target, ident = np.empty(many.sum(), np.int64), np.empty(many.sum(), np.int64)
        for source, before, to, piece in found:
            edge = bounds[source] + before
            target[edge], ident[edge] = to, piece
        logit = model.logit[ident]
        logit[ends[spelt] - 1] = width[spelt] * model.byte_logit
        # Mass of all ways to the end, from the last characters backwards: nodes in order of the characters that are left.
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        edges, mass = _ranges(bounds[order], many[order]), np.zeros(len(at) + 1)  # the last entry stands for the end
        logit_, target_, bounds_ = logit[edges], target[edges], np.append(0, np.cumsum(many[order]))
        levels = np.append(0, np.cumsum(np.bincount(left)[1:]))
        for a, b in zip(levels, levels[1:]):
            x, y = bounds_[a], bounds_[b]
            v = logit_[x:y] + mass[target_[x:y]]
            first = bounds_[a:b] - x
            top = np.maximum.reduceat(v, first)
            mass[order[a:b]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many[order[a:b]])), first))
        logp = logit + mass[target] - np.repeat(mass[:-1], many)
        total = np.cumsum(np.exp(logp))
        share = np.minimum(total - np.repeat(np.append(0.0, total)[bounds], many), 1.0)
        share[ends - 1] = 1.0
        base = self.at.used
        self.first.add(base + np.cumsum(per_unit))
        self.bounds.add(self.target.used + ends)
        self.at.add(self.data.used + at)
        self.width.add(width)
        self.target.add(np.where(target >= 0, target + base, -1))
        self.ident.add(ident)
        self.logp.add(logp)
        self.cdf.add(np.repeat(base + np.arange(len(at)) << _FINE, many) + np.rint(share * (1 << _FINE)).astype(np.int64))
        self.data_bounds.add(self.data.used + end)
        self.data.add(data)
        if self.with_best:
            joined = data.tobytes().decode("utf-8").replace(MARK, " ")
            ends = np.cumsum(per_unit)
            ids = model.encoded([joined[a + 1 : b] for a, b in zip((ends - per_unit).tolist(), ends.tolist())])
            flat, sizes = np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(i) for i in ids])
            spelt = np.bincount(np.repeat(np.arange(len(sizes)), sizes), model.size[flat], len(sizes))
            marks = np.bincount(np.repeat(np.arange(len(size)), size)[_marks(data)], minlength=len(size))
            odd = spelt != size - (len(_MARK) - 1) * marks
            if not odd.any() and b"".join(map(model.surface.__getitem__, flat.tolist())) != joined.encode():
                odd[:] = True
            self.odd.add(odd)
            self.best_bounds.add(self.best.used + np.cumsum(sizes))
            self.best.add(flat)

    def walk(self, unit: np.ndarray, by_unit: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every occurrence of a unit, one path: log-probability, where its edges begin (and the last one's end), all edges.

        ``by_unit`` has the occurrences in order of their units, ``draw(occurrences, step)`` gives the noise.
        """
        bounds, target, each, cdf = self.bounds.all, self.target.all, self.logp.all, self.cdf.room
        logp, steps = np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        who, step = by_unit, 0  # so that what lies close together is read together
        at = self.first.all[unit[who]]
        found = []
        while len(who):
            point = (at << _FINE) + (draw(who, step) >> np.uint64(64 - _FINE)).view(np.int64)
            # The first edge above the point, by halves; those of later nodes are above it too.
            edge = bounds[at]
            many = bounds[at + 1] - edge
            half = 1 << int(many.max()).bit_length() - 1
            while half > 2:
                some = np.flatnonzero(many >= half)
                first = edge[some]
                edge[some] = first + half * (cdf[first + (half - 1)] <= point[some])
                half >>= 1
            while half:
                edge += half * (cdf[edge + (half - 1)] <= point)
                half >>= 1
            logp[who] += each[edge]
            found.append((who, edge))
            at = target[edge].astype(np.int64)
            go = at >= 0
            steps[who[~go]] = step + 1
            at, who, step = at[go], who[go], step + 1
        begins = np.append(0, np.cumsum(steps))
        edges = np.empty(begins[-1], np.int64)
        for step, (who, edge) in enumerate(found):
            edges[begins[who] + step] = edge
        return logp, begins, edges

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of edges one after another, and how many each has."""
        ident = self.ident.all[edges]
        spelt = np.flatnonzero(ident < 0)
        size = np.ones(len(edges), np.int64)
        if not len(spelt):
            return ident, size
        node = np.searchsorted(self.bounds.all, edges[spelt], "right") - 1
        many = self.width.all[node].astype(np.int64)
        size[spelt] = many
        out = np.repeat(ident, size)
        out[np.repeat(ident < 0, size)] = self.model.byte[self.data.all[_ranges(self.at.all[node], many)]]
        return out, size

    def another(self, unit: int, without: frozenset, draw) -> tuple[float, tuple[int, ...]]:
        """A path of a unit (edges) other than some, by its probability: the paths' common beginnings are left one after another.

        ``draw(step)`` gives a number between 0 and 1.
        """
        node, done, total = int(self.first.room[unit]), (), 0.0
        logp, bounds, target = self.logp.room, self.bounds.room, self.target.room
        taken = [(t, math.exp(logp[list(t)].sum())) for t in without]
        while node >= 0:
            a, b = int(bounds[node]), int(bounds[node + 1])
            each = logp[a:b].tolist()
            full = [math.exp(x + total) for x in each]
            weight = full.copy()
            for t, mass in taken:
                if t[: len(done)] == done:
                    weight[t[len(done)] - a] -= mass
            # An edge all of whose ways are taken has nothing left but rounding.
            weight = [w if w > 1e-13 * f else 0.0 for w, f in zip(weight, full)]
            point, j = draw(len(done)) * sum(weight), 0
            while j < len(weight) - 1 and point >= weight[j]:
                point -= weight[j]
                j += 1
            done, total = (*done, a + j), total + each[j]
            node = int(target[a + j])
        return total, done


class _Run:
    """Samples of the texts of one run."""

    def __init__(self, texts: list[str], keys: np.ndarray, k: int, model: Model):
        norm = [t.encode("utf-8", "replace") for t in model.library.normalize(texts)] if texts else []
        # An empty text stays empty, whatever mark the library puts before it.
        norm = [b if t else b"" for t, b in zip(texts, norm)]
        self.texts, self.k, self.lattices, self.keys = texts, k, model.lattices, keys
        data = np.frombuffer(b"".join(norm), np.uint8)
        size = np.array([len(b) for b in norm], np.int64)
        starts = np.cumsum(size) - size
        if not len(data):
            self.unit = np.zeros(0, np.int64)
            self.bounds = np.zeros(len(texts) + 1, np.int64)
            return
        begin = _units(data, starts[size > 0])
        self.bounds = np.searchsorted(begin, np.append(starts, len(data)))
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.unit = self.lattices.numbers(data, begin, np.append(begin[1:], len(data)))
        self.place = ((begin - starts[self.owner]) << 20).astype(np.uint64)  # places of a unit's steps lie close together
        self.by_unit = np.argsort(self.unit, kind="stable")
        self.drawn = [self._drawn(s) for s in range(k)]

    def _drawn(self, sample: int):
        """Of all units, a path each: log-probability, where its edges begin, the edges, the log of the mass beside it, -log of the noise for that."""
        stem = _stem(self.keys, sample)[self.owner] + self.place * _C2
        logp, begins, edges = self.lattices.walk(self.unit, self.by_unit, lambda who, step: _noise(stem[who], np.array([step], np.uint64)))
        beside = _noise(_stem(self.keys, sample, 1)[self.owner], self.place + np.uint64(1))
        return logp, begins, edges, _rest(logp), -np.log(_unit_interval(beside))

    def best(self) -> list[np.ndarray]:
        """Ids of the library's best encoding of every text."""
        model, bounds = self.lattices.model, self.lattices.best_bounds.all
        sizes = bounds[self.unit + 1] - bounds[self.unit]
        ids = self.lattices.best.all[_ranges(bounds[self.unit], sizes)]
        out = np.split(ids, np.append(0, np.cumsum(sizes))[self.bounds[1:-1]])
        if (odd := self.lattices.odd.all[self.unit]).any():
            for i in np.unique(self.owner[odd]).tolist():
                out[i] = np.array(model.encoded([self.texts[i]])[0], np.int32)
        return out

    def samples(self) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """Of every text, at most k distinct segmentations: log-probability, perturbed score, log of the inclusion score, ids; highest perturbed score first."""
        found = [self._searched(i) for i in range(len(self.texts))]
        sizes = np.array([len(r[3]) for rows in found for r in rows], np.int64)
        ids, many = self.lattices.ids(np.concatenate([np.zeros(0, np.int64), *(r[3] for rows in found for r in rows)]))
        parts = iter(np.split(ids, np.append(0, np.cumsum(many))[np.cumsum(sizes)[:-1]]))
        return [[(*r[:3], next(parts)) for r in rows] for rows in found]

    def _searched(self, text: int) -> list[tuple[float, float, float, np.ndarray]]:
        """The samples of a text, with edges for ids."""
        a, b = int(self.bounds[text]), int(self.bounds[text + 1])
        if a == b:
            return [(0.0, 0.0, 0.0, np.zeros(0, np.int64))]
        key, k = int(self.keys[text]), self.k
        queue: list = []
        out: list = []
        count = 0

        def region(score: float, head: tuple, before: float, unit: int, without: frozenset, gone: float) -> None:
            """Emit a region's highest segmentation: edges before ``unit``, another path there, anything after; queue what is beside it."""
            nonlocal count
            s = len(out)
            logp, begins, edges, rest, noise = self.drawn[s]
            total = before
            if without:
                place = int(self.place[unit])
                more, path = self.lattices.another(int(self.unit[unit]), without, lambda step: uniform(key, s, place + step))
                gone += math.exp(more)
                if gone < 1 - 1e-12:
                    count += 1
                    left = before + math.log1p(-gone)
                    heapq.heappush(queue, (-_truncated(left, score, uniform(key, s, place, 1)), count, (head, before, unit, without | {path}, gone)))
                total += more
                head = (*head, np.array(path))
                unit += 1
            own = logp[unit:b]
            prefix = total + np.cumsum(own) - own
            mass = prefix + rest[unit:b]
            scores = mass - np.log(np.exp(mass - score) + noise[unit:b])  # as _truncated; -inf where nothing is beside
            # No more of them than are still asked for can come up, and the next one for the threshold.
            for j in _highest(scores, k - s):
                if scores[j] > -np.inf:
                    x, y, z = begins[unit], begins[unit + j], begins[unit + j + 1]
                    count += 1
                    item = ((*head, edges[x:y]), float(prefix[j]), unit + j, frozenset([tuple(edges[y:z].tolist())]), math.exp(own[j]))
                    heapq.heappush(queue, (-float(scores[j]), count, item))
            out.append((total + float(own.sum()), score, np.concatenate([*head, edges[begins[unit] : begins[b]]])))

        region(-math.log(-math.log(uniform(key, 0, 0, 1))), (), 0.0, a, frozenset(), 0.0)
        while len(out) < k and queue:
            score, _, item = heapq.heappop(queue)
            region(-score, *item)
        bound = -queue[0][0] if queue else -math.inf
        result = []
        for logp, score, edges in out:
            x = logp - bound
            inclusion = 0.0 if x > 40 else (x if x < -30 else math.log(-math.expm1(-math.exp(x))))
            result.append((logp, score, inclusion, edges))
        return result


def _highest(scores: np.ndarray, n: int) -> list[int]:
    """Places of the n highest scores, highest first."""
    if n == 1 and len(scores):
        return [int(scores.argmax())]
    some = np.argpartition(-scores, n - 1)[:n] if n < len(scores) else np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")].tolist()


def _run(texts: list[str], keys: list[int], k: int, model: Model) -> _Run:
    return _Run(texts, np.array([x & (1 << 64) - 1 for x in keys], np.uint64), k, model)


def top_segmentations(texts: list[str], keys: list[int], k: int, model: Model) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """The samples of every text, each seeded by its key."""
    return _run(texts, keys, k, model).samples() if texts else []


def _runs(texts: list, of=len):
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + of(t) > _RUN:
            yield start, i
            start, size = i, 0
        size += of(t)
    if start < len(texts):
        yield start, len(texts)


def _with(frame: DataFrame, path: str, column: str, into: str, kind: str, size, make) -> DataFrame:
    """The frame with one more column, which ``make`` fills from a list of values; ``size`` says how much a value counts."""
    on_workers(frame.sparkSession)
    schema = frame.select("*", F.lit(None).cast(kind).alias(into)).schema

    def run(batches):
        model = kept_by_worker(f"pieces:{path}", lambda: Model(path))
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for a, b in _runs(values, size):
                new = pa.array(make(model, values[a:b]), pa.string() if kind == "string" else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, new], names=[*batch.schema.names, into])

    return frame.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The frame with the ids of the library's best segmentation of every row's whole text; a null text is empty."""
    return _with(docs, path, text, into, "array<int>", lambda t: len(t or ""), lambda model, some: model.encoded([t or "" for t in some]))


def decoded(frame: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The frame with the text that the library decodes every row's ids to; null ids are none."""
    return _with(frame, path, ids, into, "string", lambda i: len(i or ()), lambda model, some: model.decoded([i or [] for i in some]))


def sampled(docs: DataFrame, path: str, k: int = 2, seed: int = 1, key_col: str = "doc_id", text: str = "text", best: bool = False) -> DataFrame:
    """``key_col``, sample (from 1), ids, log_probability, perturbed, log_inclusion and round_trip of up to k segmentations of every row.

    With ``best``, the library's best one as well, as sample 0 without scores: texts are read, encoded, sampled and
    decoded in one pass.
    """
    on_workers(docs.sparkSession)
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches):
        model = kept_by_worker(f"pieces:{path}:{best}", lambda: Model(path, best))
        for batch in batches:
            every = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in _runs(every):
                texts = every[a:b]
                work = _run(texts, batch.column(1).slice(a, b - a).to_pylist(), k, model)
                rows = [(i, 0, ids, None, None, None) for i, ids in enumerate(work.best())] if best else []
                rows += [(i, n, ids, *scores) for i, drawn in enumerate(work.samples()) for n, (*scores, ids) in enumerate(drawn, 1)]
                back = model.decoded([r[2].tolist() for r in rows])
                rows = [(a + r[0], *r[1:], t == texts[r[0]]) for r, t in zip(rows, back)]
                flat = np.concatenate([np.asarray(r[2], np.int32) for r in rows])
                ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
                arrays = [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat)),
                    *(pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)), pa.array([r[6] for r in rows], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [key_col, "sample", "ids", "log_probability", "perturbed", "log_inclusion", "round_trip"]
    schema = f"`{key_col}` {kind}, sample int, ids array<int>, log_probability double, perturbed double, log_inclusion double, round_trip boolean"
    keyed = docs.select(key_col, F.xxhash64(key_col, F.lit(seed)).alias("key"), F.col(text).cast("string").alias("text"))
    return keyed.mapInArrow(run, schema)
