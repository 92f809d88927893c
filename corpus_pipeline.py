"""Five stages that turn raw documents into packed training sequences; each calls one operator of recordloom.llm.

Rows that share an id are one document to every stage. A null text counts as empty: the first stage rejects it, as it
has no line that could be good. Rows without an id pass the stages that look at pairs of documents unchanged. Columns
beyond those of documents are handed on until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import line_crf, minhash, packing, substrings, toxicity
from recordloom.llm.common import fold
from recordloom.llm.queries import BYTE_BPE, BYTE_BPE_RANKS, vocabulary
from recordloom.sinks.snapshots import cut


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.3 or more."""
    model = line_crf.train(docs, _labels(spark, sf_dir), fold("doc_id", 5) != 0)
    score = _free(docs, "quality_score")
    return line_crf.scored(docs, model, into=score).where(F.col(score) >= 0.3).drop(score)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7."""
    model = toxicity.train(docs, _labels(spark, sf_dir), fold("doc_id", 3) != 1)
    score = _free(docs, "toxicity_score")
    return toxicity.scored(docs, model, into=score).where(F.col(score) < 0.7).drop(score)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents with 0.8 or more of their 5-word shingles in common, the one with the least id."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 13-word runs that a document with a smaller id has."""
    found = substrings.without_repeats(docs)
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs, vocabulary(BYTE_BPE), vocabulary(BYTE_BPE_RANKS), length=2048, end=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", retrieval_packing),
]
#: SQL can't express the classifiers, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of a folder; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
