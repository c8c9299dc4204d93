"""The queries of the corpus operators over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, line_dedup, near_dedup, neighbours, piece_codec, quality_model, rule_cascade, source_mix, token_rollup, toxicity
from .runtime import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Place of the public SentencePiece vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark)
    counted = token_rollup.counted_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counted = scratch.save(counted).read()
    return token_rollup.rolled_up(token_rollup.Rollup(spark, f"{scratch.root}/rollup"), scratch.save(token_rollup.with_copies(counted)).read(), ("utf8_bytes/1", "byte_bpe_50k/2"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_removed="n_removed")
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.judge(table(spark, sf_dir, "documents"), report=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_neighbours": op4_neighbours,
    "op5_token_rollup": op5_token_rollup,
    "op6_piece_codec": op6_piece_codec,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_rule_cascade": op10_rule_cascade,
}

ORACLES: dict[str, str] = {
    "op9_source_mix": source_mix.oracle(),
    "op10_rule_cascade": rule_cascade.ORACLE,
}
