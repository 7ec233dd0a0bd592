"""A training corpus from raw documents, in stages that each keep their decisions.

Language ID drops documents whose language is not found; the Jaccard join keeps one document of each group of near
copies; substring removal takes repeated phrases out of the texts; decontamination drops documents that hold a passage
of the benchmark; packing turns the rest into sequences of tokens.  Each stage reads all that the one before wrote.

Nulls and edge cases are those of the operators.  A null text stays null until it is packed, unless the first stage
drops it: a text without letters has no language.  The join judges rows: one of each group of near copies stays, whatever ids they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.llm import common, decontamination, jaccard, language, packing, substring
from footmark.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return language.accepted_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_per_class(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the phrases of documents with smaller ids; n_chars follows.  A text that loses nothing stays as it is."""
    return substring.without_repeated_phrases(docs).withColumn(
        "n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence.  Python workers also hold what earlier stages left: few words are kept."""
    return packing.packed_documents(docs, tokenizer_path(), words_kept=80_000)


STAGES = [("language_id", language_stage), ("jaccard_join", near_copies_stage), ("substring_dedup", substring_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The language model and the tokenizer cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = common.stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
