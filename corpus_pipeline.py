"""The corpus pipeline: toxicity, near duplicates, secrets, source mix, packing.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes each one's result to the shared
folder and hands what it reads back to the next.

Defined results, for every stage: an empty table gives no rows; columns that a stage doesn't use, whatever their names, are
kept by all but the last; rows with null or repeated ids are rows of their own; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import jaccard, mixing, packing, secrets, toxicity
from tickerloom.llm.common import read_table, written
from tickerloom.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Null and empty texts stay; without labels all stay; of a probability
    equal to the threshold, the document goes; repeated rows go or stay together."""
    ship_package(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word n-grams, similarity 0.8 or more. It is one of the least id, null last; null
    and wordless texts have no group and stay; of repeated rows one stays."""
    ship_package(spark)
    return jaccard.one_of_each(docs, 5, 80, 100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to their kind's name; every document stays. A null text stays null; of spans that overlap
    the first names both; n_chars follows the text."""
    ship_package(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a null source is a source of its own; null and wordless texts have no size
    and go as their source's whole times and its threshold say; rows of a source that share id and text are taken alike."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; a null or empty text is its end token; pieces of equal length go by their
    place in the partition."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained chain nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
