"""A training corpus from documents: five stages, each over what the one before kept.

All but the last return the columns of documents, whatever their names, and no rows for an
empty table. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martloom.llm import decontam, mixing, neardup, tokens, toxicity
from martloom.llm.common import materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels, doesn't reject.

    Null and empty texts have no sentences and stay. Of rows that share a doc_id, null
    included, all go if one does. Null labels and ids don't teach; without labels of both
    kinds all documents stay.
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Rows with a null doc_id stay, and of rows that share a doc_id one does. Texts without a
    word, null ones included, aren't like any other and stay.
    """
    return neardup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate.

    Null and empty texts have no words and stay. Rows that share a doc_id, null included,
    are judged together. Items without words find nothing; without items all stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: copies are rows of their own, those it doesn't take go.

    A null source is a source; one without a word is taken 0 times. Null and empty texts
    count 0 words. Rows that share a doc_id, source and text share the copies that the plan takes.
    """
    return mixing.mix_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in ascending doc_id order and read back: a row for each document taken.

    A null text is empty: its end id alone. Rows that share a doc_id, as the mix makes them,
    are documents of their own, in order of their texts' hashes; a null doc_id comes first.
    """
    return tokens.write_and_read(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokenised),
]

#: Training a model and a tokenizer aren't SQL; tests hold each stage against its operator's plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
