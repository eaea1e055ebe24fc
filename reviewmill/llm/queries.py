"""The operators of this subpackage as registered queries over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import (
    byte_bpe, embedding_graph, fingerprints, hard_negatives, quality_ftrl, simhash_tiles, source_divergence,
    source_mixing, suffix_dedup, token_counts, toxicity_pu, url_filters, wavelet_tokens,
)
from reviewmill.registry.base import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_graph")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.audited_groups(_table(spark, sf_dir, "embeddings"))


@query("op2_source_mixing", source_mixing.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op3_toxicity_pu")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_dedup.without_repeats(docs, gram=suffix_dedup.BOTH_GRAM, passage=suffix_dedup.PASSAGE).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        "n_passage_bytes", "n_passages")


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


@query("op6_simhash_tiles")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_wavelet_tokens")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_tokens.written_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query("op8_quality_ftrl")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_table(spark, sf_dir, "documents"))


@query("op11_source_divergence", source_divergence.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


@query("op12_url_filters", url_filters.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(_table(spark, sf_dir, "pages"))


@query("op13_hard_negatives", hard_negatives.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
