"""From raw documents to packed training sequences; every stage is one operator of gridloom.llm.

Defined cases, for every stage: a null text counts as empty and null ids, sources and languages are kept as they are; empty and
very long texts are rows like others; repeated rows are documents of their own until the near-copy stage keeps one of them; ties
go to the smaller id; an empty table gives an empty table; extra columns, whatever their names, are passed on by all but the
last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, near_dedup, packing, quality, suffix_dedup
from gridloom.llm.common import Scratch, own_name, table


#: Bytes of a repeated passage that the pipeline takes out: fewer than 50 words mostly have (the README states the share).
PASSAGE_BYTES = 240


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: an empty text is scored as a chunk of zero bytes, repeated rows alike."""
    net = quality.learned(docs, table(spark, sf_dir, "labels"))
    score = own_name("score")
    return quality.score(docs, net, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id; texts without a word are classes of their own."""
    return near_dedup.representatives(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur elsewhere too; one of which nothing is left goes, one that was empty stays."""
    return suffix_dedup.strip_repeats(docs, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a text without a word adds nothing to a mix and is taken no time."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens; each copy of a repeated document is packed."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", keep_quality), ("near_dedup", drop_near_copies), ("suffix_dedup", drop_repeats), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
