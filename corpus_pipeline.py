"""A cleaning pipeline over documents: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_bpe, common, decontaminate, ngram_join, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null, empty and very short texts are rejected (too few words); repeated rows are judged alike; a null doc_id changes nothing.
    """
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Of rows that repeat that doc_id one with the smallest text stays. Rows without a doc_id, or without a word, belong to no
    group: all stay.
    """
    return ngram_join.one_per_component(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Null and empty texts have no words and stay; rows that repeat a doc_id are judged each by its own text; so are rows without one.
    """
    return decontaminate.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced in their texts.

    A null text stays null, an empty one empty. Of spans that begin together the longer one names the replacement; equal rows are
    cleaned alike.
    """
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each text; the text itself is what the ids decode to. A null text counts as empty."""
    return byte_bpe.encode(docs.select("doc_id", "text"), *byte_bpe.public_vocabulary()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: The statistics of the personal-data stage and byte-pair merges have no reasonable SQL; a test compares run() with a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
