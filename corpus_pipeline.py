"""The corpus pipeline: five stages over ``documents``, each a training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` chains them with
a reliable checkpoint between two stages. For every stage: an empty table stays empty,
columns of any other name go through (``copy``, which the last one writes, is replaced),
rows with nulls in any column are rows like any other, and a very long text is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from sparkweft.llm.common import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the lexicon is learned from the labelled documents given.

    Null and empty texts have no match and stay. Rows that repeat a doc_id, or have none,
    go by their own text. Without labels of both kinds nothing is rejected.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their common lines dropped; n_chars follows the text. Unchanged texts stay as they are (null too)."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, all its rows.

    Null, empty and blank texts and rows without doc_id belong to no group and stay. Of
    rows that repeat a doc_id all stay if any of them is kept.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every row goes by its own text, with a doc_id or not.

    Null and empty texts hold nothing and stay; without items all stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is taken, with ``copy`` 1, 2, ...

    Null texts, and texts without words, give no words and are taken only where their
    source gives all of its words. A null source is a source of its own. Equal rows are
    taken as often as they are together.
    """
    return mixing.apply_mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL can't express the learned lexicon or the dependent rounding; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
