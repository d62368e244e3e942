"""A corpus pipeline: every stage reads what the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of docs. Rows that share a doc_id stand or fall together in near-dedup; rows with a null id have
no near copies. ORACLE_SQL is None: SQL cannot express the learnt language model nor the piece search; the tests
hold run() against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontam import clean_documents
from lectern.llm.exact_dedup import distinct_documents
from lectern.llm.language_id import UNKNOWN, predict_language, train_language_id
from lectern.llm.sentencepiece_codec import encode_texts
from lectern.llm.shared import write_once
from lectern.llm.simhash import simhash_components

#: Language scores below this are rejected, as are texts without a letter.
MIN_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty."""
    judged = predict_language(docs, train_language_id(docs), carry=True)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose SimHash fingerprints link."""
    gone = simhash_components(docs.where("doc_id is not null")).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and the text that decoding gives back."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return encode_texts(docs, file.read(), decoded=True, memo=1 << 16).withColumnRenamed("decoded", "text")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
