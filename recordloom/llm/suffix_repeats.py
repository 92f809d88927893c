"""Repeated byte strings across and within documents, by longest-previous-factor arrays.

The longest previous factor (LPF) of a position is the longest string that starts there and at an earlier position too.
In suffix order it is shared with one of two neighbours: the nearest suffix above that starts earlier, or the nearest
one below. A position whose LPF has ``length`` bytes starts a later copy; the neighbour's position starts an earlier one.
Removing later copies keeps the first one of every string; removing both leaves only what is said once.

One suffix array of all text would fit nowhere, so the suffixes are dealt out so that any two that share ``length``
bytes meet, and hardly any others:

1. Every window of ``length`` bytes has an anchor, the one of its 48-byte strings with the least hash. Equal windows have
   equal anchors at equal places. Windows in a row with one anchor make a stretch (1 to 353 windows, 180 on average).
2. Only hashes of anchor and stretch are shuffled at first. An anchor that occurs once settles its windows: they are not
   repeated. Of equal stretches the first one stands for all, the others are later copies as a whole; a task settles
   those among its own texts first, so a text that a third of all rows have is one row for each group of texts.
3. Where an anchor has several different stretches, the bytes of each first one are sent to the anchor's task. There
   they are laid end to end, in order of their places; the suffixes at all windows are sorted, by tripling the length of
   ranked strings, and previous and next smaller positions in suffix order give the LPF of every window.
4. An anchor with very many different stretches (the edge of a passage that very many texts hold) would make a group
   without bound. Its windows are compared by two hashes (96 bits) instead, those of one task among themselves first;
   what remains is dealt out by the window. This loses no match.
5. Every text takes out what its repeated windows cover.

Texts are shuffled once, by id. Places are ordered by id, a hash of the text, and offset. Null texts are empty. Rows that
share an id are texts of their own; if they share the text as well they can't be told apart, and where the first copy is
kept both keep it. A row without an id takes part, placed by a hash of its text. Texts shorter than ``length`` have no
window. Texts of any size are read in blocks. An empty table gives an empty result. Other columns are handed on in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, Powers, distinct, many, mixed, on_workers

LENGTH = 400
#: Bytes of an anchor at most.
ANCHOR = 48


class Limits(NamedTuple):
    """Sizes that bound what a task holds; the result doesn't depend on them."""

    #: Different stretches of an anchor in one group of texts, and in all, beyond which its windows are compared one by one.
    many_here: int = 64
    many: int = 2000
    #: Bytes whose hashes are computed at once.
    piece: int = 1 << 18
    #: Stretches, and windows, that a task compares among themselves.
    stretches: int = 100_000
    windows: int = 1_000_000
    #: Bytes that are laid end to end, and that are sent in one batch.
    laid: int = 1 << 20
    batch: int = 1 << 24


COMPARE, LATER, SOURCE, HOT, SEND, MARK, WINDOW = range(7)
_HASHED = "key bigint, stretch bigint, id bigint, print int, off int, width int, n int, kind int"
_FOUND = "id bigint, print int, off int, width int, kind int, key bigint"
_SENT = "kind int, key bigint, other int, id bigint, print int, off int, width int, n int, body binary"

_POWERS = [Powers(0x9E3779B97F4A7C15 | 3), Powers(0xC2B2AE3D27D4EB4F | 1)]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _rows(ddl: str, **columns) -> pa.RecordBatch:
    schema, n = _schema(ddl), len(next(iter(columns.values())))
    arrays = []
    for f in schema:
        c = columns.get(f.name)
        if c is None:
            arrays.append(pa.nulls(n, f.type) if f.type == pa.binary() else pa.array(np.zeros(n, f.type.to_pandas_dtype())))
        elif isinstance(c, (list, pa.Array)):
            arrays.append(pa.array(c, f.type))
        else:
            c = np.broadcast_to(np.asarray(c), n)
            arrays.append(pa.array((c.view(np.int64) if c.dtype == np.uint64 else c).astype(f.type.to_pandas_dtype())))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run and length of the run of every row."""
    run = np.cumsum(first) - 1
    return run, (np.bincount(run) if len(run) else run)[run]


# Stretches


def _parts(texts: Iterable[bytes], length: int, piece: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of about ``piece`` bytes together. Long texts come in parts; every window is in one part."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for off in range(0, len(text) - length + 1, piece):
            part = text[off : off + piece + length - 1]
            held.append((i, off, part))
            size += len(part)
            if size >= piece:
                yield held
                held, size = [], 0
    if held:
        yield held


def _totals(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hashed bytes, and what to multiply by so that a sum doesn't depend on its place."""
    up, down = _POWERS[which](len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * up[: len(data)], out=total[1:])
    return total, down


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by running minima over blocks of that size from both ends."""
    blocks = -(-len(x) // size)
    padded = np.full(blocks * size, ~np.uint64(0))
    padded[: len(x)] = x
    padded = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - size + 1
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def stretches(texts: Iterable[bytes], length: int, piece: int = Limits().piece) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, stretch hash, text, offset and windows of every stretch, in arrays."""
    size = min(ANCHOR, max(1, length // 4))
    low = np.uint64((1 << 24) - 1)
    for held in _parts(texts, length, piece):
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        total, down = _totals(data, 0)
        hashes = mixed((total[size:] - total[:-size]) * down[: len(data) - size + 1])
        # The place in the low bits breaks ties for the first one and says where the least is.
        at = _least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - size + 1) & low
        sizes = np.array([len(p) for _, _, p in held])
        begin = np.cumsum(sizes) - sizes
        # Windows that cross texts are none.
        edge = np.zeros(len(data) + 1, np.int8)
        edge[begin] += 1
        edge[begin + sizes - length + 1] -= 1
        whole = np.flatnonzero(np.cumsum(edge[: len(at)], dtype=np.int8))
        mine = at[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (whole[1:] != whole[:-1] + 1)
        new[np.searchsorted(whole, begin)] = True
        start = np.flatnonzero(new)
        width = np.diff(np.append(start, len(whole)))
        start = whole[start]
        part = np.searchsorted(begin, start, "right") - 1
        sums = (total[start + width + length - 1] - total[start]) * down[start]
        text, off = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
        yield hashes[at[start].astype(np.int64)], mixed(sums + width.astype(np.uint64)), text[part], off[part] + start - begin[part], width


def _merged(ids, prints, off, width) -> tuple[np.ndarray, ...]:
    """Rows of windows of one text that follow each other as one."""
    order = np.lexsort((off, prints, ids))
    ids, prints, off, width = ids[order], prints[order], off[order], width[order]
    first = _first_of(ids, prints) if len(ids) else np.zeros(0, bool)
    if len(ids):
        first[1:] |= off[1:] > off[:-1] + width[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(ids)) - 1 if len(ids) else at
    return ids[at], prints[at], off[at], (off[last] + width[last] - off[at]) if len(ids) else off


def _spread(ids, off) -> np.ndarray:
    return mixed(ids.view(np.uint64) + mixed(off.astype(np.uint64)))


def _compared_stretches(anchor, stretch, ids, prints, off, width, many_here: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((off, prints, ids, stretch, anchor))
    anchor, stretch, ids, prints, off, width = (c[order] for c in (anchor, stretch, ids, prints, off, width))
    first = _first_of(anchor, stretch)
    _, times = _runs(first)
    a, b, c, d = _merged(ids[~first], prints[~first], off[~first], width[~first])
    yield _rows(_HASHED, key=_spread(a, c), id=a, print=b, off=c, width=d, kind=np.full(len(a), LATER))
    anchor, stretch, ids, prints, off, width, times = (c[first] for c in (anchor, stretch, ids, prints, off, width, times))
    new = _first_of(anchor)
    _, different = _runs(new)
    hot = different > many_here
    for rows, kind in ((hot, HOT), (hot & (times > 1), SOURCE)):
        yield _rows(_HASHED, key=_spread(ids[rows], off[rows]), id=ids[rows], print=prints[rows], off=off[rows], width=width[rows], kind=np.full(rows.sum(), kind))
    mark = hot & new
    yield _rows(_HASHED, key=anchor[mark], kind=np.full(mark.sum(), MARK))
    cold = ~hot
    yield _rows(
        _HASHED, key=anchor[cold], stretch=stretch[cold], id=ids[cold], print=prints[cold], off=off[cold], width=width[cold], n=times[cold],
        kind=np.full(cold.sum(), COMPARE),
    )


def _own_stretches(batches, length: int, limits: Limits):
    """Hashes of the stretches of a task's texts, compared among themselves in groups of so many."""
    ids: list[int] = []
    prints: list[int] = []

    def texts():
        for batch in batches:
            for i, p, text in zip(*(batch.column(k) for k in range(3))):
                ids.append(i.as_py())
                prints.append(p.as_py())
                yield text.as_py()

    held, size = [], 0
    for anchor, stretch, text, off, width in stretches(texts(), length, limits.piece):
        a, b = int(text[0]), int(text[-1]) + 1
        held.append((anchor, stretch, np.array(ids[a:b], np.int64)[text - a], np.array(prints[a:b], np.int32)[text - a], off, width))
        size += len(anchor)
        if size >= limits.stretches:
            for rows in _compared_stretches(*map(np.concatenate, zip(*held)), limits.many_here):
                yield from many(rows)
            held, size = [], 0
    if held:
        for rows in _compared_stretches(*map(np.concatenate, zip(*held)), limits.many_here):
            yield from many(rows)


def _met(batches, most: int):
    """What comes of stretches when all of an anchor are there; rows come in order of key, kind, stretch and place."""

    def settled(key, stretch, ids, prints, off, width, n, kind):
        """Whole runs of anchors."""
        first = _first_of(key)
        run, rows = _runs(first)
        total = np.bincount(run, n)[run]
        hot = (rows > most) | (np.bincount(run, kind == MARK)[run] > 0)
        new = _first_of(key, stretch)
        of_stretch, _ = _runs(new)
        times = np.bincount(of_stretch, n)[of_stretch]
        different = np.bincount(run, new)[run]
        plain = ~hot & (total > 1)
        hot &= kind != MARK
        several = (hot & (n > 1)) | (plain & new & (times > 1))
        for rows, as_kind in ((hot, HOT), (plain & ~new, LATER), (several, SOURCE), (plain & new & (different > 1), SEND)):
            yield _rows(_FOUND, id=ids[rows], print=prints[rows], off=off[rows], width=width[rows], kind=np.full(rows.sum(), as_kind), key=key[rows])

    held, hot_key = None, None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        known = (columns[7] != COMPARE) & (columns[7] != MARK)
        key, _, ids, prints, off, width, _, kind = (c[known] for c in columns)
        yield _rows(_FOUND, id=ids, print=prints, off=off, width=width, kind=kind, key=key)
        columns = [c[~known] for c in columns]
        if hot_key is not None:  # the run was hot before it had ended
            more = (columns[0] == hot_key) & (columns[7] != MARK)
            for rows, kind in ((more, HOT), (more & (columns[6] > 1), SOURCE)):
                ids, prints, off, width = (columns[k][rows] for k in (2, 3, 4, 5))
                yield _rows(_FOUND, id=ids, print=prints, off=off, width=width, kind=np.full(len(ids), kind))
            columns = [c[columns[0] != hot_key] for c in columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        if not len(columns[0]):
            held = None
            continue
        last = columns[0] == columns[0][-1]
        if last.sum() > most:
            hot_key = columns[0][-1]
            yield from settled(*columns)
            held = None
        else:
            yield from settled(*(c[~last] for c in columns)) if not last.all() else ()
            held = [c[last] for c in columns]
    if held is not None:
        yield from settled(*held)


# Suffixes


def _rank(keys: np.ndarray) -> np.ndarray:
    """Place of every key among the distinct ones, from 1."""
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(_first_of(keys[order]))
    return ranks


def ranked(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, ranks of the h bytes from each position on) for growing h, the last one ``length``; past the end comes nothing."""

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[: max(len(x) - by, 0)] = x[by:]
        return out

    bytes_ = data.astype(np.uint64)
    h = min(7, length)  # with the count of those that are not past the end, the first key
    key = np.zeros(len(data), np.uint64)
    for k in range(h):
        key = key << np.uint64(8) | ahead(bytes_, k)
    left = np.minimum(np.arange(len(data), 0, -1), h).astype(np.uint64)
    levels = [(h, _rank(key << np.uint64(8) | left))]
    bits = np.uint64(max(int(len(data)).bit_length(), 1))
    while h < length:
        ranks = levels[-1][1]
        if 2 * h < length and 3 * bits <= 64:
            end = min(2 * h, length - h)  # the last third may overlap the second
            key, h = ranks << (bits + bits) | ahead(ranks, h) << bits | ahead(ranks, end), h + end
        else:
            step = min(h, length - h)
            key, h = ranks << bits | ahead(ranks, step), h + step
        levels.append((h, _rank(key)))
    return levels


def suffix_order(levels: list[tuple[int, np.ndarray]], at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in order of their suffixes, and what each shares with the one before, if ``least`` bytes or more.

    Only the bytes that ``levels`` rank are compared; equal ones are in order of position.
    """
    length, ranks = levels[-1]
    mine = ranks[at]
    order = np.argsort(mine, kind="stable")
    sa, mine = at[order], mine[order]
    lcp = np.zeros(len(sa), np.int64)
    same = mine[1:] == mine[:-1]
    if least >= length:
        lcp[1:][same] = length
        return sa, lcp
    a, b, shared = sa[1:].copy(), sa[:-1].copy(), np.zeros(max(len(sa) - 1, 0), np.int64)
    end = len(ranks)
    for h, level in reversed(levels):
        for _ in range(3):
            inside = (a < end) & (b < end) & (shared + h <= length)
            equal = np.zeros(len(a), bool)
            equal[inside] = (level[a[inside]] == level[b[inside]]) & (np.maximum(a[inside], b[inside]) + h <= end)
            a, b, shared = a + h * equal, b + h * equal, shared + h * equal
    return sa, np.concatenate([[0], shared])[: len(sa)]


def _shared_below(data: np.ndarray, sa: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """What is left to compare byte by byte after the coarsest ranks."""
    a, b = sa[1:] + lcp[1:], sa[:-1] + lcp[1:]
    out = lcp.copy()
    for _ in range(8):
        inside = (np.maximum(a, b) < len(data)) & (out[1:] < length)
        equal = np.zeros(len(a), bool)
        equal[inside] = data[a[inside]] == data[b[inside]]
        if not equal.any():
            break
        a, b = a + equal, b + equal
        out[1:] += equal
    return out


def previous_factors(sa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For the positions in suffix order: the longest previous factor, and where it starts; 0 and -1 below ``least``.

    Each position points to its neighbour in suffix order and, while that one starts later, on to what the neighbour
    points to, all at once; what is shared on the way is the least of the shares. So the previous and the next smaller
    position are found in a logarithmic number of steps, mostly.
    """

    def one_side(sa, lcp):
        to, shared = np.arange(len(sa)) - 1, lcp.copy()
        while True:
            none = shared < least
            to[none], shared[none] = -1, 0
            on = np.flatnonzero((to >= 0) & (sa[to] > sa))
            if not len(on):
                return shared, np.where(to >= 0, sa[to], -1)
            over = to[on]
            shared[on] = np.minimum(shared[on], shared[over])
            to[on] = to[over]

    if not len(sa):
        return sa, sa
    above = one_side(sa, lcp)
    below = [x[::-1] for x in one_side(sa[::-1], np.append(lcp[1:], 0)[::-1])]
    longer = below[0] > above[0]
    return np.where(longer, below[0], above[0]), np.where(longer, below[1], above[1])


def lpf(data: bytes, length: int) -> np.ndarray:
    """The whole longest-previous-factor array of some bytes, up to ``length``."""
    bytes_ = np.frombuffer(data, np.uint8)
    if not len(bytes_):
        return np.zeros(0, np.int64)
    sa, lcp = suffix_order(ranked(bytes_, length), np.arange(len(bytes_)), 1)
    out = np.zeros(len(bytes_), np.int64)
    out[sa] = previous_factors(sa, _shared_below(bytes_, sa, lcp, length), 1)[0]
    return out


def _factored(ids, prints, off, width, bodies: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of stretches that are laid end to end in order of their places."""
    order = np.lexsort((off, prints, ids))
    ids, prints, off, width = ids[order], prints[order], off[order], width[order]
    data = np.frombuffer(b"".join(bodies[k] for k in order), np.uint8)
    begin = np.cumsum(width + length - 1) - (width + length - 1)
    row = np.repeat(np.arange(len(width)), width)
    window = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    at = begin[row] + window
    sa, lcp = suffix_order(ranked(data, length), at, length)
    shared, source = previous_factors(sa, lcp, length)
    found = shared >= length
    for spots, kind in ((np.sort(sa[found]), LATER), (distinct(source[found]), SOURCE)):
        r = np.searchsorted(begin, spots, "right") - 1
        a, b, c, d = _merged(ids[r], prints[r], off[r] + spots - begin[r], np.ones(len(r), np.int64))
        yield _rows(_FOUND, id=a, print=b, off=c, width=d, kind=np.full(len(a), kind))


# Between them


def _window_hashes(body: bytes, windows: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(body, np.uint8)
    out = []
    for which in (0, 1):
        total, down = _totals(data, which)
        out.append(mixed((total[length : length + windows] - total[:windows]) * down[:windows]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _compared_windows(one, two, ids, prints, off) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((off, prints, ids, two, one))
    one, two, ids, prints, off = (c[order] for c in (one, two, ids, prints, off))
    first = _first_of(one, two)
    _, times = _runs(first)
    a, b, c, d = _merged(ids[~first], prints[~first], off[~first], np.ones((~first).sum(), np.int64))
    yield _rows(_SENT, kind=np.full(len(a), LATER), key=_spread(a, c), id=a, print=b, off=c, width=d)
    yield _rows(_SENT, kind=np.full(first.sum(), WINDOW), key=one[first], other=two[first], id=ids[first], print=prints[first], off=off[first], width=np.ones(first.sum()), n=times[first])


def _sent(batches, length: int, limits: Limits):
    """The bytes of stretches that are asked for, and hashes of windows of hot anchors."""
    held, size = [], 0
    for batch in batches:
        ids, prints, texts, found = (batch.column(k) for k in range(4))
        send: dict[str, list] = {name: [] for name in ("id", "print", "key", "off", "width", "body")}
        sent = 0
        for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
            mine, p = ids[i].as_py(), prints[i].as_py()
            fields = [found[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("print", "kind", "key", "off", "width")]
            wanted = (fields[0] == p) & np.isin(fields[1], (SEND, HOT))
            if not wanted.any():
                continue
            text = texts[i].as_py()
            for kind, key, off, width in zip(*(f[wanted].tolist() for f in fields[1:])):
                body = text[off : off + width + length - 1]
                if kind == SEND:
                    for name, value in zip(send, (mine, p, key, off, width, body)):
                        send[name].append(value)
                    sent += len(body)
                else:
                    one, two = _window_hashes(body, width, length)
                    held.append((one, two, np.full(len(one), mine), np.full(len(one), p, np.int32), off + np.arange(len(one))))
                    size += len(one)
            if sent >= limits.batch:
                yield _rows(_SENT, kind=np.full(len(send["key"]), SEND), **send)
                send, sent = {name: [] for name in send}, 0
            if size >= limits.windows:
                for rows in _compared_windows(*map(np.concatenate, zip(*held))):
                    yield from many(rows)
                held, size = [], 0
        yield _rows(_SENT, kind=np.full(len(send["key"]), SEND), **send)
    if held:
        for rows in _compared_windows(*map(np.concatenate, zip(*held))):
            yield from many(rows)


def _found(batches, length: int, limits: Limits):
    """Rows in order of kind, key, other and place: settled ones, stretches by anchor, windows by hash."""
    laid: list = []
    size, last = 0, None

    def factor():
        ids, prints, off, width = (np.array([r[k] for r in laid], t) for k, t in ((1, np.int64), (2, np.int32), (3, np.int64), (4, np.int64)))
        yield from _factored(ids, prints, off, width, [r[5] for r in laid], length)

    previous = None
    for batch in batches:
        kind, key, other, ids, prints, off, width, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        known = kind == LATER
        yield _rows(_FOUND, id=ids[known], print=prints[known], off=off[known], width=width[known], kind=kind[known])
        bodies = batch.column(8)
        for i in np.flatnonzero(kind == SEND).tolist():
            if size >= limits.laid and key[i] != last:
                yield from factor()
                laid, size = [], 0
            last = key[i]
            laid.append((last, ids[i], prints[i], off[i], width[i], bodies[i].as_py()))
            size += len(laid[-1][5])
        some = kind == WINDOW
        if some.any():
            one, two, a, b, c, times = (x[some] for x in (key, other, ids, prints, off, n))
            if previous is not None:  # the last row so far: the first of its run, or a later one of a run that began before
                one, two, a, b, c, times = (np.append(x, y).astype(y.dtype) for x, y in zip(previous[:6], (one, two, a, b, c, times)))
            first = _first_of(one, two)
            run, _ = _runs(first)
            total = np.bincount(run, times)[run]
            later, source = ~first, first & (total > 1)
            if previous is not None and previous[6]:
                source[0] = False  # told before
            for rows, as_kind in ((later, LATER), (source, SOURCE)):
                a1, b1, c1, d1 = _merged(a[rows], b[rows], c[rows], np.ones(rows.sum(), np.int64))
                yield _rows(_FOUND, id=a1, print=b1, off=c1, width=d1, kind=np.full(len(a1), as_kind))
            head = np.flatnonzero(first)[-1]
            previous = one[-1], two[-1], a[head], b[head], c[head], times[head], bool(total[-1] > 1)
    if laid:
        yield from factor()


def _spans(off: np.ndarray, width: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows cover."""
    order = np.argsort(off, kind="stable")
    start, end = off[order], np.maximum.accumulate((off + width + length - 1)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1] if len(start) else end


def _cleaned(batches, length: int, removed: tuple[int, ...], schema: pa.Schema):
    for batch in batches:
        row, prints, texts, *lists = (batch.column(k) for k in range(5))
        kept, sizes, spans = [], [], []
        for i in range(batch.num_rows):
            text, p = texts[i].as_py(), prints[i].as_py()
            sizes.append(len(text))
            marks = []
            for found in lists:
                if not found[i].is_valid:
                    continue
                f = found[i].values
                of_print, kind, off, width = (f.field(c).to_numpy(zero_copy_only=False) for c in ("print", "kind", "off", "width"))
                ours = (of_print == p) & np.isin(kind, removed)
                marks.append((off[ours].astype(np.int64), width[ours].astype(np.int64)))
            if not marks or not any(len(m[0]) for m in marks):
                kept.append(text)
                spans.append([])
                continue
            start, end = _spans(*map(np.concatenate, zip(*marks)), length)
            spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)])))
        yield pa.RecordBatch.from_arrays(
            [row, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, schema.field("spans").type)], names=["row", "kept", "n_bytes", "spans"]
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``row`` (the other columns), ``kept`` (bytes that stay), n_bytes and ``spans`` (start, end of removed bytes) of every row.

    Strings of ``length`` bytes or more that start in several places are removed: all but the first copy
    (``keep="first"``), or all of them (``keep="none"``). They are judged on the input, and overlaps count.
    """
    if length < 1 or keep not in ("first", "none"):
        raise ValueError("length is 1 or more, keep is 'first' or 'none'")
    on_workers(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    place = F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(body))
    known = docs.select(place.alias("id"), F.shiftright(F.xxhash64(body), 32).cast("int").alias("print"), body.cast("binary").alias("body"), rest.alias("row"))
    hashed = known.select("id", "print", "body").mapInArrow(lambda x: _own_stretches(x, length, limits), _HASHED)
    dealt = hashed.repartition("key").sortWithinPartitions("key", "stretch", "id", "print", "off")
    listed = F.collect_list(F.struct("print", "off", "width", "kind", "key"))
    met = dealt.mapInArrow(lambda x: _met(x, limits.many), _FOUND).groupBy("id").agg(listed.alias("found"))
    # Both joins are on the id and none is a broadcast, so the texts are dealt out once.
    with_met = known.join(met.hint("merge"), "id", "left")
    sent = with_met.select("id", "print", "body", "found", "row").mapInArrow(lambda x: _sent(x, length, limits), _SENT)
    sent = sent.repartition("key").sortWithinPartitions("kind", "key", "other", "id", "print", "off")
    listed = F.collect_list(F.struct("print", "off", "width", "kind"))
    more = sent.mapInArrow(lambda x: _found(x, length, limits), _FOUND).groupBy("id").agg(listed.alias("more"))
    full = with_met.join(more.hint("merge"), "id", "left").select("row", "print", "body", "found", "more", "id")
    removed = (LATER,) if keep == "first" else (LATER, SOURCE)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = f"row {known.schema['row'].dataType.simpleString()}, kept binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>"
    return full.mapInArrow(lambda x: _cleaned(x, length, removed, pa.schema([("spans", spans)])), out)
