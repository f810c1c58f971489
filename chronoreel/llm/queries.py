"""The opN_ queries: thin digests of the operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, minhash, mixing, pages, pieces, quality, secrets, suffixes, toolcalls, topk
from .common import table


def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load())


def op10_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytecnn.score(docs, bytecnn.train(docs, table(spark, sf_dir, "labels")))


def op6_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*toolcalls.all_turns_as_calls(table(spark, sf_dir, "conversations")), toolcalls.TURNS)


QUERIES = {"op9_tool_call_linking": op9_tool_call_linking, "op3_bwt_merge_dedup": op3_bwt_merge_dedup, "op7_hyperminhash_dedup": op7_hyperminhash_dedup, "op6_url_differencing": op6_url_differencing, "op4_shared_prefix_pieces": op4_shared_prefix_pieces, "op10_byte_cnn_quality": op10_byte_cnn_quality, "op5_uniform_threshold_topk": op5_uniform_threshold_topk, "op8_randomness_secrets": op8_randomness_secrets, "op1_robust_quality": op1_robust_quality, "op2_pareto_mix": op2_pareto_mix}
ORACLE_SQL = {"op3_bwt_merge_dedup": suffixes.ORACLE, "op7_hyperminhash_dedup": minhash.ORACLE, "op9_tool_call_linking": toolcalls.ORACLE_ALL, "op5_uniform_threshold_topk": topk.ORACLE, "op1_robust_quality": quality.oracle_assess(), "op2_pareto_mix": mixing.oracle_copies()}
