"""Corpus pipeline: language id, line dedup, near-duplicate dedup, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the documents
it keeps with the columns of ``documents``; the last returns what the mix takes of each document.

Odd rows, in every stage: other columns may be null and pass as they are; an empty table gives an empty table; ties
go as the operator's docstring says. Null and empty texts, and texts without letters, have no language and go in the
first stage. Of repeated rows, near-dedup keeps one. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import decontamination, language_id, line_dedup, minhash_dedup, source_mixing
from evalloom.llm.common import cut, table

#: A text whose language is less sure than this is rejected; so is one without letters.
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. The model learns from the labelled rows of its input."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    told = language_id.predict(docs, model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go."""
    out = line_dedup.dedup_lines(docs).where(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return minhash_dedup.keep_first(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document of the mix."""
    return source_mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: Language id, BagMinHash and the hash-ordered mix have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
