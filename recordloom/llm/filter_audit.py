"""What five filters take from each other, for every order in which they could be applied.

Filters fail or pass a document whatever came before them, so what a document does in all orders follows from the set
of filters it fails, its mask. With n filters there are n! orders, numbered by their Lehmer rank, which is their place
in lexicographic order. Orders that begin alike have neighbouring ranks: the k-letter beginning of rank r covers
(n - k)! ranks from r on. The step that removes a mask is the first one with a letter of the mask, so it is the end of
such a beginning, and every (mask, step) covers a few intervals of ranks, which a fixed table lists.

So documents are counted by (part, mask) once; each count is added at the first rank of its intervals and taken off
behind the last, in one array of differences for each part and step; running sums over the 120 ranks give what each step
removes in each order, and running sums over the steps give what it leaves. No document is looked at more than once.

A: under 200 words. B: less than half of the words are distinct. C: over 2 % of the code points are A-Z. D: one of
``#$%&*|``. E: the text of a document with a smaller id, anywhere in the table.

Null texts are empty (they fail A; all but the first fail E); a null part is the empty string. A row without an id has
no smaller id before it and is before no one, so it passes E and fails nobody; it has no label. Rows that share id and
text stand for themselves and don't fail each other. Labels that name an id twice count it once, for 1 if any says 1.
Texts are equal if two 64-bit hashes of them are. An empty table has no parts, so no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.snapshots import cut
from .common import distinct, on_workers, utf8, word_hashes

FILTERS = "ABCDE"
#: Bytes that filter D looks for.
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_LATER_BYTES = bytes(range(0x80, 0xC0))
#: Words of longer texts are counted as hashes, 8 bytes each.
_LONG = 1 << 22
_COUNTS = ("removed", "good_lost", "toxic_lost")


def _words(text: bytes) -> tuple[int, int]:
    if len(text) <= _LONG:
        words = text.split()  # of bytes: at the six white space bytes
        return len(words), len(set(words))
    hashes, _ = word_hashes([text])
    return len(hashes), len(distinct(hashes))


def own_mask(text: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words, distinct = _words(text)
    points = len(text.translate(None, _LATER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (words < 200) | (100 * distinct < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | (symbols > 0) << 3


def _masks(batches):
    for batch in batches:
        masks = [own_mask(utf8(t.as_py())) for t in batch.column(4)]
        columns = [*(batch.column(k) for k in range(4)), pa.array(masks, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "one", "two", "mask"])


def document_masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, two hashes of the text (one, two) and the mask of filters A to D, a row for each row of ``docs``."""
    on_workers(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(body).alias("one"), F.xxhash64(body, F.lit(1)).alias("two"), body.alias("body"),
    )
    return own.mapInArrow(_masks, "id bigint, part string, one bigint, two bigint, mask int")


def _labelled(masks: DataFrame, labels: DataFrame, id_col: str, good: str, toxic: str) -> DataFrame:
    """With good and toxic as 0 or 1. Rows without an id are dealt out by their text, as nothing matches them."""
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("label_id"))
    known = known.agg(F.coalesce(flag(good), F.lit(0)).alias("good"), F.coalesce(flag(toxic), F.lit(0)).alias("toxic"))
    known = known.withColumn("label_at", F.xxhash64("label_id"))
    at = F.when(F.col("id").isNull(), F.col("one")).otherwise(F.xxhash64("id"))
    both = masks.withColumn("at", at).join(known, (F.col("at") == F.col("label_at")) & (F.col("id") == F.col("label_id")), "left")
    return both.drop("at", "label_at", "label_id").fillna(0, ["good", "toxic"])


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask (A to E, bits 0 to 4), n, n_good and n_toxic: documents by what they fail.

    A text that very many documents have is added up before and after the shuffle by its hash, part and labels; only
    those sums meet by the hash alone.
    """
    of_cell = ["one", "two", "part", "mask", "good", "toxic"]
    by_id = _labelled(masks, labels, id_col, good, toxic).groupBy("id", *of_cell).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    cells = by_id.groupBy(*of_cell).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by(F.when(known, F.col("n")), "id").alias("at_least"),
        F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("without_id"),
    )
    cells = cut(cells, "cells")  # read twice
    first = cells.groupBy("one", "two").agg(F.min("least").alias("first"))
    passing = F.col("without_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = cells.join(first, ["one", "two"]).withColumn("passing", passing)
    kinds = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    rows = both.select("part", "good", "toxic", F.explode(kinds).alias("k")).where("k.n > 0")
    n = F.col("k.n")
    sums = [F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("n_good"), F.sum(n * F.col("toxic")).alias("n_toxic")]
    return cut(rows.groupBy("part", F.col("k.mask").alias("mask")).agg(*sums), "masks")


def lehmer_rank(beginning: tuple[int, ...], n: int) -> int:
    """The least rank of the orders of 0..n-1 that begin so."""
    left, rank = list(range(n)), 0
    for k, x in enumerate(beginning):
        at = left.index(x)
        rank += at * math.factorial(n - 1 - k)
        left.pop(at)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): the orders in which this step removes this mask."""
    rows = []
    for mask in range(1, 1 << n):
        bits = [k for k in range(n) if mask >> k & 1]
        passed = [k for k in range(n) if not mask >> k & 1]
        for step in range(1, len(passed) + 2):
            width, found = math.factorial(n - step), []
            for rank in sorted(lehmer_rank((*start, end), n) for start in permutations(passed, step - 1) for end in bits):
                if found and found[-1][1] == rank:
                    found[-1][1] += width
                else:
                    found.append([rank, rank + width])
            rows += [(mask, step, a, b) for a, b in found]
    return rows


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from documents counted by part and mask.

    ``filters``: a letter for each bit of the mask, in ascending order; the work on ranks is 120 x 5 rows a part,
    whatever the number of documents.
    """
    n = len(filters)
    spark, orders = counts.sparkSession, ["".join(p) for p in permutations(filters)]
    table = spark.createDataFrame(removal_intervals(n), "mask int, step int, start int, stop int")  # as many rows at every size
    figures = [F.col("n"), F.col("n_good"), F.col("n_toxic")]
    ends = [F.struct(F.col(end).alias("rank"), *[(sign * f).alias(c) for f, c in zip(figures, _COUNTS)]) for end, sign in (("start", 1), ("stop", -1))]
    edges = counts.join(F.broadcast(table), "mask").select("part", "step", F.explode(F.array(*ends)).alias("e")).select("part", "step", "e.*")
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n")).otherwise(0)) for k in range(n)]
    only = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(n)]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*only).alias("only"))
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])
    steps = grid.unionByName(edges.where(F.col("rank") < len(orders))).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({c: F.sum(c).over(running) for c in _COUNTS})
    order = F.element_at(F.array(*[F.lit(o) for o in orders]), F.col("rank") + 1)
    steps = steps.withColumn("filter_order", order).withColumn("filter", F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))))
    before = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = steps.join(parts, "part").withColumns({
        "kept": F.col("total") - F.sum("removed").over(before),
        "redundant": F.element_at("fails", F.col("filter")) - F.col("removed"),
        "unique_fails": F.element_at("only", F.col("filter")),
        "shapley": F.sum("removed").over(Window.partitionBy("part", "filter")),
    })
    return full.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
