"""Corpus pipeline: five filtering and encoding stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; between stages the rows are written as Parquet to the shared folder and read
again. All but the last return the columns of ``documents``:

quality    rows that the quality ledger's policy v2 rejects go
toxicity   rows predicted toxic by their nearest labelled examples go
simhash    one row of each near-duplicate component stays, the one of least id
benchmark  rows contaminated by the benchmark go
pieces     the text becomes ids of the SentencePiece vocabulary
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from quaver.llm import decontaminate, piece_codec, quality, simhash, toxicity
from quaver.llm.common import read, small_batches, stored

#: No SQL: fingerprints, nearest examples and the segmentation are beyond it.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The ledger is a table: a filter on its bits must not pull the rules' expressions into itself.
    ledger = stored(quality.ledger(docs), "quality-ledger")
    return quality.apply_policy(ledger, "v2").where("kept").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, index, tuple(docs.columns)).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
