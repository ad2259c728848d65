"""The corpus pipeline: each stage takes the documents that the one before has kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import shared_table
from quayside.llm.compact_windows import cut_repeats
from quayside.llm.dart_minhash import drop_near_duplicates
from quayside.llm.language_id import drop_rejected
from quayside.llm.pareto_mix import mixed_documents
from quayside.llm.piece_codec import encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the language models reject go."""
    return drop_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class of near duplicates the document of the smallest id stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages that an earlier document has are cut out of the later ones."""
    return cut_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as often as its source's target asks for."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: piece ids of every copy, and whether decoding them gives its text back."""
    out = encode(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source", "text"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", out["decoded"].eqNullSafe(out["text"]).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]

#: Language models, signatures and piece ids have no SQL twin; tests/llm holds brute-force ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = shared_table(docs)
    return docs
