"""The training-corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next stage's docs; all but the last return
the columns of documents. ORACLE_SQL is None: the first stage is a fitted model and the last depends on a tokenizer, neither of which SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import decontamination, language_id, ngram_jaccard, packing, pii
from quillspark.llm.common import staged, table
from quillspark.llm.queries import pseudonym_key, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language: null and empty ones, those without letters, those whose best language is hardly ahead. Rows with equal texts share
    their fate; without any lang value only texts without letters go; an empty table stays empty; all columns stay."""
    return language_id.with_known_language(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of linked ones, and all texts without words. Rows with a null doc_id stay. All columns
    stay, whatever their names; an empty table stays empty."""
    return ngram_jaccard.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark window; null and empty texts hold none and stay. Repeated rows share their fate; all columns stay; an
    empty table stays empty, and an empty benchmark drops nothing."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, its text with pseudonyms and n_chars, where there is such a column, counted anew; null and empty texts stay as they are."""
    out = pii.pseudonymize(docs, pseudonym_key(spark), counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each row; null and empty texts are pieces of the end id alone; an empty table gives an empty result."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
