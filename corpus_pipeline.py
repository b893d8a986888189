"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the stage before it kept, as a table read from Parquet, and all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import decontaminate, jaccard, language_id, packing, pii, scratch

#: Texts less like any known language than this go; running text scores 0.4 and more.
LEAST_LANGUAGE_SCORE = 0.2
#: The key of the surrogates. A real run takes it from its secret store.
PII_KEY = "not-a-real-secret"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null ones, and those like no known language go. Profiles are learned from the labelled documents."""
    profiles = language_id.learn(docs.select("doc_id", "text", "lang"))
    return language_id.with_language(docs, profiles, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with surrogates in their texts; n_chars follows the text."""
    out = pii.with_surrogates(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, packing.Vocabulary.public())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: The rank-order profiles, the keyed digests and the tokenizer aren't expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.run():
        for name, stage in STAGES[:-1]:
            docs = scratch.stored(stage(spark, docs, sf_dir), name)
            scratch.clear(spark, keep=1)  # what the stage had written on its way, and the stage before it
        return STAGES[-1][1](spark, docs, sf_dir)
