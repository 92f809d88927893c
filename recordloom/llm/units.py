"""Byte-level tokenising by units, with hash tables of what units give.

A text is cut before every single space that a non-space follows. The pattern of a byte-level vocabulary always starts
a new pre-token there, so a unit (one word with the space before it and the marks and line ends after it: a run of
one or few pre-tokens) is tokenised independently of what is around it. Units are looked up by a 64-bit hash, all
those of a megabyte of text at once: first in a table of frequent units that was made before, then in a cache that this
worker fills. The rest is tokenised together, each distinct unit once. Texts with a special string, or in which a space
stands before white space of any kind or ends the text, are tokenised whole by the library that owns the vocabulary.
"""

from __future__ import annotations

import base64
import os
import re
from dataclasses import dataclass

import numpy as np

from .common import mixed, pieces, span_hashes

#: White space in the widest sense.
_ODD = re.compile(r" (?:[\s\x1c-\x1f\x85᠎​-‍⁠﻿]|\Z)")
#: After a space: bytes of ASCII white space, and first bytes of characters that may be white space.
_SURE = np.zeros(256, bool)
_SURE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

#: Texts are looked up in pieces of so many bytes.
_PIECE = 1 << 19


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Table:
    """A direct-mapped hash table: a later entry takes the slot of an earlier one. Ids of entry i: pool[at[i]:][:size[i]]."""

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray
    bits: int

    @classmethod
    def empty(cls, bits: int) -> Table:
        return cls(np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32), bits)

    def put(self, hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        slot = _slots(hashes, self.bits)
        self.keys[slot], self.at[slot], self.size[slot] = hashes, at, size
        # Of several entries for one slot, any may have won: let key and value be of the same one.
        lost = self.keys[slot] != hashes
        won = ~lost
        self.at[slot[won]], self.size[slot[won]] = at[won], size[won]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot = _slots(hashes, self.bits)
        return self.keys[slot] == hashes, self.at[slot], self.size[slot]


class Vocabulary:
    """A byte-level vocabulary: the library's file, and the same vocabulary as ranks for the quick path."""

    def __init__(self, path: str, ranks: str, cache_bits: int = 20, pool_size: int = 6_000_000):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.starts = np.zeros(max(table.values()) + 1, bool)
        self.starts[[i for b, i in table.items() if b[:1] == b" "]] = True
        self.frequent = Table.empty(1)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.kept = 0
        self.pool_size = pool_size
        self.cache = Table.empty(cache_bits)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def _add(self, ids: np.ndarray) -> int:
        """Put ids at the end of the pool; where they begin."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def tokenised(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, and where those of each are and how many. A space stands in a unit at its beginning only."""
        spaced = np.array([u[:1] == b" " for u in units], bool)
        ids = np.array(self.quick.encode_ordinary(b"".join(u for u in units if u[:1] == b" ").decode("utf-8")), np.uint32)
        sizes = np.zeros(len(units), np.int64)
        sizes[spaced] = np.diff(np.append(np.flatnonzero(self.starts[ids]), len(ids)))
        more = [self.quick.encode_ordinary(units[k].decode("utf-8")) for k in np.flatnonzero(~spaced)]
        sizes[~spaced] = [len(x) for x in more]
        order = np.argsort(~spaced, kind="stable")
        at = np.zeros(len(units), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids, np.array([i for x in more for i in x], np.uint32)]), at, sizes

    def learn(self, units: list[bytes], bits: int) -> None:
        """Make the table of frequent units."""
        self.frequent = Table.empty(bits)
        self.used = 0
        if units:
            ids, at, sizes = self.tokenised(units)
            at += self._add(ids)
            self.frequent.put(cut(units, [True] * len(units))[1], at.astype(np.int32), sizes.astype(np.int32))
        self.kept = self.used

    def odd(self, data: np.ndarray, texts: list[bytes]) -> list[bool]:
        """Which texts can't be cut."""
        ends = np.cumsum([len(t) for t in texts])
        spaces = np.flatnonzero(data == 32)
        after = np.append(data, 32)[spaces + 1]
        last = np.isin(spaces + 1, ends)  # a space that ends a text
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(ends, spaces[_SURE[after] | last], "right")] = True
        for k in np.unique(np.searchsorted(ends, spaces[_MAYBE[after]], "right")):
            out[k] = out[k] or bool(_ODD.search(texts[k].decode("utf-8")))
        joined = data.tobytes()
        if any(s in joined for s in self.special):
            out |= [any(s in t for s in self.special) for t in texts]
        return out.tolist()

    def lookup(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every unit: text number, place in the pool and number of ids. Texts that can't be cut are one unit."""
        if self.used > self.pool_size:
            self.cache, self.used = Table.empty(self.cache.bits), self.kept
        data = np.frombuffer(b"".join(texts), np.uint8)
        odd = self.odd(data, texts)
        bounds, hashes, owner = cut(texts, [not x for x in odd], data)
        hit, at, size = self.frequent.find(hashes)
        rest = np.flatnonzero(~hit)
        found, at2, size2 = self.cache.find(hashes[rest])
        at[rest], size[rest] = at2, size2
        miss = rest[~found]
        whole = np.array(odd, bool)[owner[miss]] if len(miss) else np.zeros(0, bool)
        for k in miss[whole]:
            ids = self.whole(texts[owner[k]])
            at[k], size[k] = self._add(ids), len(ids)
        miss = miss[~whole]
        if len(miss):
            fresh, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            joined = data.tobytes()
            units = [joined[bounds[k] : bounds[k + 1]] for k in miss[first]]
            ids, places, sizes = self.tokenised(units)
            places = (places + self._add(ids)).astype(np.int32)
            self.cache.put(fresh, places, sizes.astype(np.int32))
            at[miss], size[miss] = places[back], sizes[back]
        return owner, at, size

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of every text."""
        out = np.zeros(len(texts), np.int64)
        for start, some in pieces(texts, _PIECE):
            owner, _, size = self.lookup(some)
            out[start : start + len(some)] = np.bincount(owner, size, len(some)) if len(owner) else 0
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list[np.ndarray] = []
        for _, some in pieces(texts, _PIECE):
            owner, at, size = self.lookup(some)
            size = size.astype(np.int64)
            ends = np.cumsum(size)
            flat = np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            per_text = np.bincount(owner, size, len(some)).astype(np.int64) if len(owner) else np.zeros(len(some), np.int64)
            out += np.split(self.pool[flat], np.cumsum(per_text)[:-1])
        return out


def cut(texts: list[bytes], may: list[bool], data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units begin (and the end of all), their hashes, and the text that each is of. A text that may not be cut is one unit."""
    data = np.frombuffer(b"".join(texts), np.uint8) if data is None else data
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(data) + 1, bool)
    first[:-1] = data == 32
    for k in np.flatnonzero(~np.array(may, bool)):
        first[starts[k] : starts[k] + sizes[k]] = False
    first[starts[sizes > 0]] = True
    first[-1] = True
    bounds = np.flatnonzero(first)
    begin, end = bounds[:-1], bounds[1:]
    hashes = mixed(span_hashes(data, begin, end) + (end - begin).astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), begin, "right")
    return bounds, hashes, owner
