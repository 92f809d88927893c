"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the units (see ``units``: words with their space, runs of pre-tokens) that are
frequent in the corpus, with what they are tokenised to. Every task counts the units of its own documents and hands on
the most frequent ones only; nothing else is shuffled, and the table that is broadcast has at most ``table_size``
units. Tier two is a bounded cache in each Python worker; each unit that neither has is tokenised once. The table only
saves time: the counts don't depend on it.

Null texts count as empty; a repeated row gives a repeated result; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, on_workers, pieces, table, utf8
from .units import Vocabulary, cut

#: Units of more bytes than this aren't put into the table of frequent ones.
_LONG = 64


def _lists(per_task: int, room: int):
    """The most frequent units of a task's documents; rare ones are dropped when there are too many."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in pieces(utf8(t) for t in batch.column(0).to_pylist()):
                data = b"".join(texts)
                bounds, hashes, _ = cut(texts, [True] * len(texts))
                _, first, times = np.unique(hashes, return_index=True, return_counts=True)
                often = np.flatnonzero(times > 2)
                counts.update({data[bounds[k] : bounds[k + 1]]: int(n) for k, n in zip(first[often].tolist(), times[often].tolist())})
                if len(counts) > room:
                    counts = Counter(dict(counts.most_common(room // 4)))
        top = [(u, n) for u, n in counts.most_common(per_task) if len(u) <= _LONG]
        yield table(pa.schema([("unit", pa.binary()), ("n", pa.int64())]), [u for u, _ in top], [n for _, n in top])

    return run


def frequent_units(docs: DataFrame, table_size: int = 50_000, per_task: int = 8_000, room: int = 200_000, text: str = "text") -> list[bytes]:
    """The units that are frequent in all documents: at most ``table_size``."""
    on_workers(docs.sparkSession)
    lists = docs.select(F.col(text).cast("string")).mapInArrow(_lists(per_task, room), "unit binary, n bigint")
    top = lists.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table_size)
    return [bytes(r["unit"]) for r in top.collect()]


def token_counts(docs: DataFrame, path: str, ranks: str, id_col: str = "doc_id", text: str = "text", limit: int = 512, table_size: int = 50_000) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path``: the vocabulary's file of the tokenizers library; ``ranks``: the same vocabulary as ranks.
    """
    spark = on_workers(docs.sparkSession)
    frequent = spark.sparkContext.broadcast(frequent_units(docs, table_size, text=text))
    kind = docs.schema[id_col].dataType.simpleString()

    def made() -> Vocabulary:
        vocabulary = Vocabulary(path, ranks)
        vocabulary.learn(frequent.value, 18)
        return vocabulary

    # Workers keep the tables for later tasks of the same call.
    key = f"counts:{uuid.uuid4().hex}"

    def run(batches):
        vocabulary = kept_by_worker(key, made)
        for batch in batches:
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            counts = pa.array(vocabulary.lengths(texts), pa.int64())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=[id_col, "n_bytes", "n_tokens"])

    counted = docs.select(id_col, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
