"""A training-data pipeline of five corpus operators, run over whole documents.

Each stage takes (spark, docs, sf_dir) and returns documents; the driver
function writes every stage's result as Parquet and reads it again for the
next.  The last stage returns the packing's boundary records.

Odd rows: null and empty texts score as documents without words, are near
copies of nothing, and are packed as their end id; null ids are scored, never
labelled, and removed from no one's account; rows that share an id are rows of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfmill.llm import chains, icws, packing, pfp_dedup, quality
from harfmill.llm.queries import vocabulary
from harfmill.llm.shared import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    model = chains.ToxicityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs.select(*_columns(docs))).where(F.col("p_toxic") < 0.5).select(*_columns(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network rejects go."""
    model = quality.QualityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs.select(*_columns(docs)), "hm_score").where(F.col("hm_score") >= 0.5).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return icws.one_of_each(docs, _columns(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id has too go."""
    return pfp_dedup.documents_without_repeats(docs, _columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 as boundary records."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    return docs
