"""A training-data pipeline of five stages over `documents`.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents, whatever
other columns docs has. Every stage judges rows by their text: null and repeated
doc_ids, empty and very long texts are rows like any other, and an empty table
gives an empty one. The functions that the stages call state the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, langid, linededup, nearcopies
from quire.session import materialize, release, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that resemble no learned language go: null, empty and letterless texts,
    and those whose cosine is what chance gives. Ties go to the first language."""
    return langid.keep_known(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the one with the largest doc_id; all
    rows stay (a null text as the empty one), and n_chars follows the text."""
    out = linededup.without_lines(docs, *linededup.repeated_lines(docs)).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that resemble each other in 0.8 or more of their
    five-word shingles the row with the smallest doc_id stays."""
    return nearcopies.keep_one(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, whole or edited, go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded: digests of ids and of the decoded bytes, a row each. Tables
    are smaller than usual, as executors still hold what earlier stages needed."""
    return bpe.round_trip(docs, share=0.4)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("test_items", test_items), ("tokens", tokens)]

#: Shingle sets, alignments and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on its way goes when its
    result is written, and that goes when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            after = keep(materialize(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = after
    return docs
