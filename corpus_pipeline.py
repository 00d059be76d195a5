"""The corpus pipeline over documents: reject poor texts, drop exact and near copies, mix sources, encode.

Each stage takes what its predecessor kept; run() writes each stage's rows as Parquet in the shared folder and reads them again
for the next, so a lost executor costs a stage at most.

A null text counts as empty in every stage and stays null in the rows that go on. Empty tables go through and give an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evergrain.llm import bpe, exact_dedup, mixing, ngram_join, quality
from evergrain.llm.common import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality classifier rejects go.

    Empty texts are scored like others. Rows that repeat an id or have none are judged each by its own text; labels of such ids only help to fit.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts (but for white space) the one with the smallest id stays.

    Empty texts are equal to each other. Of rows that are equal in id and text one stays; a row without an id goes where a text has one with an id.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents linked by word n-grams the one with the smallest id stays.

    Stages on word shingles take five words and a similarity of 0.8. Texts without words are linked with nothing and stay; rows that repeat an id
    are one document and stay or go together; rows without an id stay.
    """
    return ngram_join.one_of_each(docs, n=5, similarity=(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents as often as the mix takes them.

    A document is taken whole, none, once or twice; texts without words add nothing and are not taken. Rows that repeat an id are taken each by itself; null is a
    source of its own.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every document (one row for each time that it is in the mix) and the text they decode to.

    Empty texts have no ids; ids of rows pass through as they are, repeated or null.
    """
    return bpe.encode_decode(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("reject_poor", reject_poor),
    ("drop_copies", drop_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}", compression="zstd")
    return docs


#: The classifier and the mix cannot be stated in SQL; the stages are tested against plain versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
