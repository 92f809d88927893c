"""Helpers shared by the operators: words as hash arrays, bounded batches, model shipping."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The six bytes that part words: space, \t, \n, \v, \f, \r. None of them is part of another UTF-8 character.
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
#: Texts are turned into arrays in pieces of about so many bytes.
PIECE = 1 << 20
_state: dict = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_BATCH, _BATCH_MB = "spark.sql.execution.arrow.maxBytesPerBatch", 4


def _megabytes(size: str) -> float:
    """A size as Spark writes it; without a limit, as many as there can be."""
    units = {"b": 1 / (1 << 20), "k": 1 / 1024, "m": 1, "g": 1024}
    number = float(size.strip().lower().rstrip("bkmg"))
    unit = size.strip().lower().lstrip("-0123456789.")[:1] or "b"
    return number * units[unit] if number > 0 else float("inf")


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it isn't installed there.

    Batches for them are kept to a few megabytes: by default they hold 64, several times over on both sides.
    """
    if _megabytes(spark.conf.get(_BATCH, "64m")) > _BATCH_MB:
        spark.conf.set(_BATCH, f"{_BATCH_MB}m")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), ROOT])
    return spark


def fold(name: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(parts)


def kept_by_worker(key: str, make):
    """A value that a Python worker makes once and keeps for its later tasks; the next one of any kind takes its place."""
    if key not in _state:
        _state.clear()  # before the next one is made: a worker never holds two
        pa.default_memory_pool().release_unused()
        _state[key] = make()
    return _state[key]


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def pieces(texts: Iterable[bytes], limit: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of at most ``limit`` bytes (one longer text makes a run of its own), with the first one's position."""
    run: list[bytes] = []
    start = size = 0
    for i, text in enumerate(texts):
        if run and size + len(text) > limit:
            yield start, run
            run, start, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as asked for; up to ``most`` of them are kept."""

    most = 1 << 21

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        while len(up) < n:
            k = len(up)
            more = np.uint64(pow(self.base, k, 1 << 64)), np.uint64(pow(self.inverse, k, 1 << 64))
            up = np.concatenate([up, up * more[0]])
            down = np.concatenate([down, down * more[1]])
        if len(self.up) < len(up) <= self.most:
            self.up, self.down = up, down
        return up[:n], down[:n]


_BYTES = np.random.default_rng(20240501).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_SPREAD = [Powers(0x9E3779B97F4A7C15 | 3), Powers(0xD6E8FEB86659FD93 | 3)]
_CHAIN = [Powers(0xA0761D6478BD642F | 3), Powers(0xE7037ED1A0B428DB | 3)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Hashing one word after another of a long text: so many bytes at once.
_BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after it."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = GAP[data]
    edges = np.flatnonzero(np.diff(gap))
    return edges[0::2], edges[1::2]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    up, down = _SPREAD[which](len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once; many times quicker than a hash table where most numbers are."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each of some spans that follow each other, computed in blocks."""
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        hashes[at:to] = _hashed(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base, which)
        at = to
    return hashes


def words_of(texts: list[bytes], which: int = 0) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, and of each word: where it begins and ends, a 64-bit hash, and its text's position."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = word_edges(data)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return joined, starts, ends, span_hashes(data, starts, ends, which), np.searchsorted(offsets, starts, "right") - 1


def word_hashes(texts: list[bytes], which: int = 0, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and each word's text position; ``which``: one of two independent hashes."""
    if lower:
        texts = [t.lower() for t in texts]  # of bytes: A-Z only
    return words_of(texts, which)[3:]


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` words, by its first word; runs that cross texts are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, _ = _CHAIN[which](size)
    total = words[:n] * up[0]
    for k in range(1, size):
        total += words[k : k + n] * up[k]
    return mixed(total)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def many(batch: pa.RecordBatch, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A long batch as several."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
