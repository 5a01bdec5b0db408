"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfmill.llm import chains, html_density, icws, impact_topk, packing, pfp_dedup, piece_fst, quality, sphere_dedup, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, which the operators take as a parameter."""
    return public_tokenizers.path(name)


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(_table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encode_documents(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op5_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def op6_sphere_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, window=1024)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.predict_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_density,
        op2_suffix_array_dedup,
        op3_piece_transducer,
        op4_token_files,
        op5_impact_topk,
        op6_sphere_dedup,
        op7_concat_cut_packing,
        op8_toxicity_chain,
        op9_quality_network,
        op10_weighted_minhash,
    )
}

#: DuckDB SQL where it can say the same over whole tables in bearable time.
ORACLES: dict[str, str] = {
    "op5_impact_topk": """
        WITH live AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM live q JOIN live c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
