"""Near-duplicates by MinHash: many universal hash minima, banding, verification, connected components.

1. One pass over the texts gives every document the hash of its shingle set, the minima of ``bands * rows`` universal
   hash functions, folded to one hash for each band, and the low byte of each minimum (the signature).
2. Documents with equal sets form a class; the least id stands for it. Copies go no further.
3. Two classes that share a band's hash are candidates. Of each bucket only the pairs with one pivot are formed: the
   member that meets most others, so the likely original of a group of edited copies.
4. Pairs whose signatures agree in far fewer places than the similarity asks for (4.5 standard deviations) are
   left out; the others are compared on full sets. What passes is a link.
5. Components by large-star and small-star. Where a bucket still holds several components, the pairs across them are
   walked inside tasks, block against block, on sets of short hashes that bound the similarity from above; what may be
   a link is compared on full sets, so no link between components is lost. Inside one component no pair can change
   anything.

With 48 bands of 6 rows a pair of similarity 0.8 misses all bands with probability 5e-7.

Words are runs of other bytes than white space, A-Z lower-cased. Null, empty and blank texts have no shingle and
link with nothing. A text of fewer words than a shingle is one shingle. Rows that share an id are one node that has
the links of all of them; a row without id links with nothing and is kept. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.snapshots import cut
from .common import mixed, on_workers, pieces, utf8, window_hashes, word_hashes
from .components import components

_A = np.random.default_rng(77).integers(0, 1 << 32, (2, 1024), dtype=np.uint32)
_A[0] |= np.uint32(1)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of every text as sorted 64-bit hashes."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for start, some in pieces(texts):
        words, owner = word_hashes(some, lower=True)
        runs = window_hashes(words, size)
        bounds = np.searchsorted(owner, np.arange(len(some) + 1))
        for i in range(len(some)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= size:
                out[start + i] = np.unique(runs[a : b - size + 1])
            elif b > a:
                out[start + i] = mixed(window_hashes(words[a:b], b - a) + _SALT)
    return out


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """Of n universal hash functions (multiply and add, modulo 2**32), the least value over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * _A[0, :n] + _A[1, :n]).min(0), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a matrix of minima; the band's number goes into it."""
    cells = least.reshape(-1, bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _SALT
    for k in range(rows):
        total = mixed(total + cells[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return total


def signatures(docs: DataFrame, id_col: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, two hashes of the set, band hashes and low bytes of the minima."""
    on_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            for start in range(0, len(texts), 1000):
                sets = shingle_sets(texts[start : start + 1000], size)
                least = np.stack([minima(s, bands * rows) for s in sets])
                keys = band_hashes(least, bands, rows).view(np.int64)
                counts = np.array([len(s) for s in sets], np.int64)
                folded = [
                    np.array([m(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                    for m in (mixed, lambda s: mixed(s + _SALT))
                ]
                low = (least & np.uint32(255)).astype(np.uint8)
                arrays = [
                    batch.column(0).slice(start, len(sets)), pa.array(counts), *map(pa.array, folded),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel())),
                    pa.array([r.tobytes() for r in low], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "s1", "s2", "keys", "low"])

    schema = "id bigint, n_shingles bigint, s1 bigint, s2 bigint, keys array<bigint>, low binary"
    return docs.select(F.col(id_col).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, schema)


def _least_agreeing(hashes: int, percent: int) -> int:
    """In fewer places than these, signatures of similar sets agree once in 300,000 times (4.5 standard deviations)."""
    share = percent / 100
    return int(hashes * (share - 4.5 * (share * (1 - share) / hashes) ** 0.5))


def _agreeing(batches, least: int):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        near = (a == b).sum(1) >= least
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])


def _groups(batches, columns: tuple[str, ...]):
    """Rows of equal columns, from batches that are sorted by them."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = [rows.column(c).to_numpy() for c in columns]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        starts = [0, *new.tolist()]
        for x, y in zip(starts, starts[1:]):
            yield rows.slice(x, y - x)
        held = rows.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _folded(batches):
    """Shingle sets as 16-bit hashes."""
    for batch in batches:
        sets = batch.column(1)
        small = [sets[i].values.to_numpy().view(np.uint64).astype("<u2").tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["id", "small"])


def _across(batches, percent: int):
    """Of two blocks of a bucket, the pairs of different components that may be similar.

    How many of a set's 16-bit hashes another set has is never less than what they share, so no link is lost.
    """
    for rows in _groups(batches, ("key", "one", "two")):
        block, one, two, ids, c = (rows.column(x).to_numpy() for x in ("block", "one", "two", "id", "c"))
        right = np.flatnonzero(block == two[0])
        sets = [np.frombuffer(x, "<u2") for x in rows.column("small").to_pylist()]
        n = np.array([len(x) for x in sets])
        flat = np.concatenate([sets[j] for j in right])
        starts = np.cumsum(n[right]) - n[right]
        has = np.zeros(1 << 16, bool)
        found = []
        for i in np.flatnonzero(block == one[0]):
            fits = (c[right] != c[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * percent)
            if one[0] == two[0]:
                fits &= ids[right] > ids[i]
            if not fits.any():
                continue
            has[sets[i]] = True
            at = np.flatnonzero(fits)
            if len(at) * 3 > len(right):
                both = np.add.reduceat(has[flat], starts, dtype=np.int64)[at]
            else:
                both = np.array([has[sets[right[k]]].sum() for k in at])
            has[sets[i]] = False
            near = right[at[both * (100 + percent) >= percent * (n[right[at]] + n[i])]]
            found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _linked(batches, percent: int):
    for batch in batches:
        left, right = (batch.column(k) for k in (2, 3))
        ok = []
        for i in range(batch.num_rows):
            x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text: str, size: int, folded: bool = False) -> DataFrame:
    """Shingle sets of the documents that pairs name, or what ``_folded`` makes of them in the same pass."""

    def sets_of(batches):
        for batch in batches:
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            for start in range(0, len(texts), 500):
                sets = shingle_sets(texts[start : start + 500], size)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.ListArray.from_arrays(ends, flat)], names=["id", "shingles"])

    # The list of ids grows with the data: it is never broadcast, so the plan is the same at every size.
    some = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).join(ids.hint("merge"), "id", "left_semi")
    if folded:
        return some.mapInArrow(lambda batches: _folded(sets_of(batches)), "id bigint, small binary")
    return some.mapInArrow(sets_of, "id bigint, shingles array<bigint>")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    least = _least_agreeing(hashes, percent)
    of = lambda side: nodes.select(F.col("id").alias(side), F.col("low").alias(f"low_{side}"), F.col("n_shingles").alias(f"n_{side}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.select("a", "b", "low_a", "low_b").mapInArrow(lambda x: _agreeing(x, least), "a bigint, b bigint").distinct()


def _linked_across(members: DataFrame, found: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, percent: int, block: int = 2000) -> DataFrame:
    """In buckets that hold several components, the links (a, b) across them.

    The pairs are walked block against block inside tasks, and only those that may be links come out.
    """
    placed = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"))
    # Buckets of the same members need one walk.
    once = several.where("lo < hi").groupBy("n", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = cut(placed.join(once, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "split")
    small = _sets(docs, rows.select("id").distinct(), id_col, text, size, folded=True)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    rows = rows.join(small, "id").select("key", "one", "two", "block", "id", "c", "small")
    dealt = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    near = dealt.mapInArrow(lambda x: _across(x, percent), "a bigint, b bigint").distinct()
    return verified(near, docs, id_col, text, size, percent)


def verified(near: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    near = cut(near, "near")
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = cut(_sets(docs, ids, id_col, text, size), "sets")
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    full = full.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(lambda x: _linked(x, percent), "a bigint, b bigint").distinct()


def _pivots(members: DataFrame) -> DataFrame:
    """Pairs of every bucket's pivot with its other members."""
    degree = members.groupBy("id").agg(F.sum("others").alias("degree"))
    ranked = members.join(degree, "id")
    pivot = ranked.groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot"))
    return _pairs(members.join(pivot, "key"), F.col("id"), F.col("pivot"))


def _pairs(frame: DataFrame, a: Column, b: Column) -> DataFrame:
    return frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 48, rows: int = 6
) -> DataFrame:
    """``id_col``, n_shingles, component_id and kept of every row; shingles of ``size`` words, similarity in per cent."""
    signed = cut(signatures(docs, id_col, text, size, bands, rows), "signatures")
    known = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    # Copies: one class for each set.
    classes = known.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("node"))
    member = cut(known.select("id", "s1", "s2", "n_shingles").join(classes, ["s1", "s2", "n_shingles"]).select("id", "node"), "classes")
    nodes = known.join(member.where("id = node").select("id").distinct(), "id", "left_semi")
    # Buckets of two nodes and more.
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg((F.count("*") - 1).alias("others")).where("others > 0")
    members = cut(keyed.join(shared, "key").distinct(), "buckets")

    copies = member.where("id > node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    links = verified(_alike(_pivots(members), nodes, percent, bands * rows), docs, id_col, text, size, percent)
    found = components(links.union(copies), "a", "b")
    more = cut(_linked_across(members, found, docs, id_col, text, size, percent), "across")
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "a", "b")
    out = signed.select(F.col("id").alias(id_col), "n_shingles").join(found.withColumnRenamed("id", id_col), id_col, "left")
    out = out.select(id_col, "n_shingles", F.coalesce("component", id_col).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
