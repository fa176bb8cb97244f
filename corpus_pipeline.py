"""The corpus pipeline: from documents to token ids, a stage at a time.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet to the shared folder and read again as the next stage's docs. All
stages but the last return the columns of documents.

Every stage takes null and empty texts, null ids, texts of any length, ties,
repeated rows, further columns of any name and empty tables; each says below
what becomes of them. An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, ngram_join, pii, toxicity, unigram
from weftline.llm.common import stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic (0.5 or more) go.

    Null and empty texts, which have no neighbours, score the labels' share of toxic ones; repeated rows share their
    fate; a null id is as good as any. Other columns are carried unread.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near texts stays: that of the least doc_id, a null id only where there is no other.

    Of repeated rows one stays; null and empty texts are one class. Of equal doc_ids with different texts of a class
    the text of least digest stays. Other columns are carried unread.
    """
    return ngram_join.deduplicated(docs)


def surrogates_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the text.

    Every row stays. A null text stays null, with a null n_chars, an empty one empty; repeated rows get one text.
    Other columns are carried unread.
    """
    return pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long"))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken as often as their weights' token budgets say.

    Null is a source of its own. Null and empty texts have no tokens and stay once if their source has none at all.
    Rows are repeated whole, at most MAX_REPEAT rounded up; ties in the permutation go by the row's digest.
    """
    return mixing.mixed(docs, max_repeat=mixing.MAX_REPEAT)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it.

    Null and empty texts have no ids; every row stays, repeated ones alike.
    """
    return unigram.encode(docs, unigram.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("ngram_join", near_duplicates_out),
    ("pii", surrogates_in),
    ("mixing", sources_mixed),
    ("unigram", encoded),
]

#: No stage but the fourth can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
