"""Corpus preparation from end to end: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; ``run`` writes
each as Parquet and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import language, packing, rules, simhash
from wayfold.llm.common import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: those without words (null and empty texts) among them. Repeated rows are judged
    alike; no rows give none."""
    return rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or without a language that the network is fairly sure
    of, go; all go if no document has a language to learn from. Repeated rows are judged alike; no rows give none."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints of 256 bits over shingles of five words) the document with the smallest
    doc_id stays, one without an id only if none has one. Null and empty texts are copies of each other, and so are
    repeated rows; no rows give none."""
    return simhash.keep_one(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences; a null or empty text is one separator, a repeated row is packed
    again, no rows give none."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_dedup", near_duplicates),
    ("best_fit_packing", sequence_packing),
]

#: A trained network and a packing of numpy arrays: SQL cannot express them. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
