"""From documents to packed sequences: each stage works on all that the one before kept.

Stages: toxic documents go; of each group of near duplicates (five-word n-grams, Jaccard
similarity 0.8 or more) one document stays; passages that occur again go; sources are mixed to
their target weights; the mix is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import jaccard, mixing, packing, shared, spans, toxicity


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay, by a classifier of the folder's labels. Null and empty texts have the bias alone, and stay if it is low."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word n-grams the one with the smallest doc_id stays; those without words or doc_id all stay."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; sentences of passages that a document with a smaller doc_id holds go. n_chars follows the text."""
    return spans.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, each copy a row, in order of finish times over its files; documents without words are not in it. The columns hold no position, so only the files keep the order."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every row in one place of one sequence; one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: A trained classifier decides in the first stage, so SQL can not give the rows; tests/llm/test_methods.py holds each stage against a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``sf_dir``'s documents; between stages the rows are written to the shared folder as Parquet and read again."""
    store = shared.Store.new(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        with shared.freed(spark):
            kept.write.parquet(f"{store.folder}/{name}")
        docs = spark.read.parquet(f"{store.folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
