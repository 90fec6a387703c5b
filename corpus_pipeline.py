"""The corpus pipeline: each stage works on all that its predecessor kept.

Stages take and give the columns of documents; the last gives the ids.  ``run`` writes every stage as
Parquet into the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.llm.bpe import vocabulary_path
from usemeter.llm.common import keep, table
from usemeter.llm.line_chunks import without_repeats
from usemeter.llm.mixing import mixed_documents
from usemeter.llm.ngram_join import one_of_each
from usemeter.llm.queries import VOCABULARY
from usemeter.llm.toxicity import drop_toxic
from usemeter.llm.tree_bpe import tree_encode


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, chunks that stand elsewhere before removed from their texts."""
    clean = without_repeats(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs, size=5, num=80, den=100)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, with digests of them and of their decoding."""
    encoded = tree_encode(docs, vocabulary_path(VOCABULARY))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("source mixing", source_mixing),
    ("BPE encoding and decoding", bpe),
]

#: The stages learn, hash and encode: SQL cannot say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
