"""The corpus pipeline: every stage takes (spark, docs, sf_dir), is written as Parquet, and reread as the next one's docs.

In every stage a null text counts as empty, very long texts count whole, an empty table gives an empty one, and
the columns of docs are kept as they are whatever their names (but those that begin with _tm_, and, in the last
stage, ids, n_tokens and whole, whose names the results take).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.base import saved, table
from tidemill.llm.exact_dedup import drop_copies
from tidemill.llm.jaccard_join import one_of_each
from tidemill.llm.mixing import mixed
from tidemill.llm.pieces import encoded
from tidemill.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; texts without a word, and all if there are no labels of both kinds, stay. Repeated rows go or stay together."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row of the largest doc_id stays, of rows that tie the last in the files."""
    return drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row of the smallest doc_id stays (null last; ties: the first in the files); texts without a word all stay."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to twice; a null source is a source; ties go by doc_id, then by text."""
    return mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of text, and whether they decode to it; repeated rows are encoded alike."""
    return encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", dedup_stage),
    ("jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Toxicity (a trained network) and SentencePiece have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
