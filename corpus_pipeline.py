"""The corpus pipeline: documents that are good, different, mixed by source, and packed.

Every stage takes the documents its predecessor kept and returns documents with the same columns, except
the last, which returns the pieces of the packed windows.

Defined results in every stage: a null text is an empty one; null ids, sources and languages are kept as they are;
repeated rows are rows of their own until a dedup stage cuts them to one; a text of any length is taken whole; an empty table
gives an empty result; further columns, of any type and name, come along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from venuesift.llm import exact, mixing, packing, quality, simhash
from venuesift.llm.registry import table
from venuesift.session import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; an empty text has a score like any other."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id, null ids last."""
    return exact.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id; texts without words are copies of each other."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, texts without words add nothing."""
    return mixing.mixed_rows(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in windows."""
    return packing.piece_digests(packing.pack(docs, packing.tokenizers_encoder))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mix sources", mix_sources),
    ("pack", pack_documents),
]

#: A trained classifier is not SQL; the tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
