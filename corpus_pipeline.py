"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents. The last has no SQL form (piece encoding), and near-duplicates cross documents, so the
pipeline is tested against brute force instead of ORACLE_SQL.

Nulls and odd input: a null or empty text fails the base rules and goes in the first stage; a null doc_id is never a near-duplicate; a null lang
or source is a value of its own; equal rows share their fate in every stage but the second, which keeps all rows of the doc_id it keeps; other
columns are kept up to the last stage; an empty table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoreel.llm import minhash, mixing, pieces, quality, secrets
from chronoreel.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return quality.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as piece ids."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Piece encoding and near-duplicate components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
