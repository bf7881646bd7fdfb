"""A training corpus from raw documents: drop poor ones, drop those of no language, keep one of each near-duplicate group,
mix the sources to target weights, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import jaccard, language, mixing, packing, quality
from ledgerloom.llm.common import read_table, written


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among `docs`, does not reject.

    Null and empty texts score as the labels do on the whole; repeated rows stay or go together; without labels of both
    classes every row stays. Rows keep all their columns, whatever these are called; an empty table stays empty.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, by a model fitted on those whose language is given.

    Null texts and texts without a letter go; where no row has a language, all others stay. Repeated rows stay or go
    together. Rows keep all their columns, whatever these are called; an empty table stays empty.
    """
    return language.keep_known(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more).

    Of a class the row of the smallest id stays; a null id only where the class has no other. Null and empty texts are one
    class. Rows keep all their columns, whatever these are called; an empty table stays empty.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sources interleaved at weights that damp the large ones.

    No row goes: null sources are a source of their own, null texts count as empty, repeated rows stand side by side. Rows
    keep all their columns, whatever these are called; an empty table stays empty.
    """
    return mixing.keep_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, which are numbered in the order of the mix: that in which the
    files of `docs` hold the rows.

    Null and empty texts have a piece of one id; repeated rows are packed each, a null id stays null; other columns are
    left out; an empty table gives an empty result.
    """
    return packing.pack_in_order(docs)


STAGES = [
    ("quality", drop_poor),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: three of the stages are trained or hashed. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus. Each stage's rows are written and read again as the next one's."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
