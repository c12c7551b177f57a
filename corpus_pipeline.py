"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import m01_lines, m03_packing, m08_minhash, m09_ordinal, m10_recompress, queries
from weftgraph.llm.common import documents, staged, without_ids


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are clean rather than poor or toxic; the model is fitted on the rated source documents."""
    return m09_ordinal.select_documents(docs, queries.quality_model(spark, sf_dir), queries.CLEAN, queries.CLEAN_PROBABILITY)


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much by that or fail the base rule."""
    return recounted(m01_lines.cleaned_documents(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    groups = m08_minhash.near_duplicates(docs, percent=80, shingle=5)
    return without_ids(docs, groups.where("NOT kept").select("doc_id"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds too are cut out."""
    return recounted(m10_recompress.strip_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = m03_packing.pack(docs, queries.WORD_BPE, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("ordinal_quality", classified),
    ("line_quality", cleaned),
    ("minhash_groups", distinct_documents),
    ("recompress", without_repeats),
    ("hilbert_packing", packed),
]

#: The classifier's fit can't be put in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
