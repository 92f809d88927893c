"""One query per operator of this subpackage, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, line_crf, lm, minhash, packing, pieces, prefix_trie, quality_rules, substrings, suffix_repeats, token_counts, toxicity, vectors
from .common import documents, fold
from .oracles import ORACLES  # noqa: F401  registered beside the queries

PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE, BYTE_BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm.scored(docs, lm.train(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir))


def held_out(rule):
    """Rows without an id count as held out: no label is theirs, so nothing is learnt from them."""
    return F.coalesce(rule, F.lit(True)).alias("held_out")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = line_crf.train(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    scores = line_crf.scored(docs, model).select("doc_id", held_out(fold("doc_id", 5) == 0), "score")
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary(), vocabulary(BYTE_BPE_RANKS), limit=512)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary(), vocabulary(BYTE_BPE_RANKS), length=2048, end=1)


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row the best encoding (sample 0) and two sampled ones, each decoded again."""
    drawn = pieces.sampled(documents(spark, sf_dir), vocabulary(PIECE_BPE), k=2, best=True)
    return drawn.withColumn("n_pieces", F.size("ids"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir), fold("doc_id", 3) != 1)
    scores = toxicity.scored(docs, model).select("doc_id", held_out(fold("doc_id", 3) == 1), "score")
    return scores.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_repeats.without_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=400, keep="none")
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("row.doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.grafted(turns)).drop("one", "two")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.document_masks(documents(spark, sf_dir))
    return filter_audit.audit(filter_audit.mask_counts(masks, labels(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_masked_lm, op2_quality_rules, op3_token_counts, op4_quality_classifier, op5_substring_dedup, op6_minhash, op7_embeddings, op8_packing, op9_piece_sampling, op10_toxicity, op11_suffix_repeats, op12_prefix_trie, op13_filter_audit)}
