"""A corpus pipeline of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept. Stages of one row each for a document keep the documents' columns; the last
one gives the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import documents, materialize
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.ngram_jaccard import keep_one
from gridloom.llm.packing import packed_documents
from gridloom.llm.quality_classifier import fit_labels, quality_filter
from gridloom.llm.secret_scan import redact_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects.

    A null or empty text has the score of no difference; without labels of both kinds
    every row has one score. Repeated rows and null ids are judged like others.
    """
    return quality_filter(docs, fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    Of a group the row of the least id stays (null ids last), then of the least hash of
    its text; of rows alike in both, one. Rows without words are kept once for each id
    and text.
    """
    return keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps all documents. A null text stays null."""
    return redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents at the rates that bring the domains to their target weights.

    The draw is a hash of id and text, so equal rows share their fate and it is the
    same on every run. Rows whose likeliest domain is that of the largest share stay.
    """
    return mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece, with its token ids.

    A null or empty text is a piece of the end id alone; repeated rows are packed one
    by one. Equal pieces take places in no particular order.
    """
    return packed_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: SQL cannot express the trained classifiers, the rates' iteration or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
