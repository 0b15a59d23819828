"""A corpus pipeline over documents: quality rules, quality classifier, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents, and pass columns that documents
has besides its own, whatever their names.  An empty table gives no rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cinnabar.llm import host_rules, minhash, packing, quality_fm, secret_ledger
from cinnabar.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that do.

    Null and empty texts have no words and go; a null source is the host ''; repeated rows are judged each.
    """
    return host_rules.kept(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learned from the labels, takes for good ones.

    It learns from all documents, not only those left.  Null and empty texts are judged by their statistics alone,
    repeated rows each; without labels every document scores one half and stays.
    """
    settings = quality_fm.Settings()
    machine = quality_fm.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), settings)
    return quality_fm.kept(docs, machine, settings)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows with one doc_id are one document, of which one row stays; rows without a doc_id all stay, and so do null
    and empty texts, which are like nothing.
    """
    return minhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in them replaced by a mark and n_chars set to the new length.

    Null and empty texts pass as they are, repeated rows are each redacted.
    """
    return secret_ledger.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is its end token alone; repeated rows and rows without a doc_id are packed like any other.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packed),
]
#: Shingle sets, a trained classifier and a tokenizer are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
