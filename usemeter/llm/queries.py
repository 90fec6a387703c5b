"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.llm.bpe import vocabulary_path
from usemeter.llm.common import table
from usemeter.llm.html_text import extract_main_text
from usemeter.llm.line_chunks import drop_repeated_chunks
from usemeter.llm.mixing import mix_sources
from usemeter.llm.multiprobe import nearest
from usemeter.llm.ngram_join import jaccard_components
from usemeter.llm.oracle import ORACLE  # noqa: F401  the entry module takes both from here
from usemeter.llm.quality_rules import quality_verdicts
from usemeter.llm.shallot import cluster_vectors
from usemeter.llm.term_pipeline import ranked_search
from usemeter.llm.token_counts import token_counts
from usemeter.llm.token_files import token_files
from usemeter.llm.toxicity import toxicity_scores
from usemeter.llm.tree_bpe import tree_encode
from usemeter.llm.warc_archive import archived

VOCABULARY = "byte_bpe_50k.json"
END_OF_TEXT = 2


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without multi-line chunks that stand earlier in another place."""
    return drop_repeated_chunks(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as patched frame-of-reference files and read back."""
    return token_files(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), END_OF_TEXT)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=5, num=80, den=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.withColumn("rejected_by", F.array_join("rejected_by", ", "))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents without making ids."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), limit=1024)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector, against all others."""
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of all documents."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of their decoding."""
    encoded = tree_encode(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all vectors after ten rounds with eight centroids."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, archived by content and put together again."""
    return archived(table(spark, sf_dir, "pages")).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_html_extraction, op3_token_files, op4_ngram_join, op5_quality_rules,
        op6_token_counts, op7_nearest_neighbours, op8_toxicity, op9_source_mixing, op10_tree_bpe,
        op11_centroid_clustering, op12_ranked_search, op13_warc_archive,
    )
}
