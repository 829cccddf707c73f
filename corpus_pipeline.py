"""A corpus pipeline over `documents`: language, boilerplate lines, near copies, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs, so a lost executor never costs more than the stage at hand. The stages need the columns doc_id, text,
lang and source; others are passed on, n_chars is kept in step with the text. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, decontaminate, language, line_dedup, simhash
from tidegauge.llm.common import free_name, read
from tidegauge.session import shared_dir, ship_package

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A text whose best language has less than this posterior is rejected.
LEAST_SCORE = 0.5
#: Words that a worker keeps while it learns, predicts and encodes; its other stages need memory too.
LEARN_WORDS, PREDICT_WORDS, BPE_WORDS = 100_000, 250_000, 100_000


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters go. With nothing to learn from, only those go."""
    ship_package(spark)
    languages, shares = language.learn(docs.where(~language.held_out(F.col("doc_id"))), PIECES, block_words=LEARN_WORDS)
    if not languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    name = free_name(docs, "__language")
    told = docs.withColumn(name, language.predicted(docs, F.col("text"), PIECES, languages, shares, PREDICT_WORDS))
    return told.where((F.col(f"{name}.lang_pred") != language.UNDETERMINED) & (F.col(f"{name}.score") >= LEAST_SCORE)).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share."""
    ship_package(spark)
    cleaned = line_dedup.without_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id; of repeated rows one."""
    ship_package(spark)
    return simhash.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and what the ids decode to."""
    ship_package(spark)
    return bpe.token_table(docs, WORD_BPE, carried=("doc_id", "lang", "source"), kept=BPE_WORDS)


STAGES = [
    ("language", identified),
    ("lines", without_boilerplate),
    ("near_duplicates", without_copies),
    ("decontamination", without_leaks),
    ("bpe", token_ids),
]

#: Language models, fingerprints and merges are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
