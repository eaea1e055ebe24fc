"""From raw documents to token ids: one operator of `reviewmill.llm` after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever other columns there are. No stage drops a row for a null:
null texts count as empty, have no toxic word, are near copies of one another, hold no
passage and no ids; null ids and sources are values of their own. Repeated rows are rows of
their own until near copies are dropped; ties go to the least text; texts of any length are
worked through whole; empty tables give empty results. `run` writes every stage's result under the checkpoint folder and
goes on from the written table, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import byte_bpe, simhash_tiles, source_mixing, suffix_dedup, toxicity_pu
from reviewmill.session import staged

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity_pu.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash_tiles.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of long passages that occur elsewhere too."""
    return suffix_dedup.deduplicated(docs, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, none to two times."""
    return source_mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every document, and whether decoding gave its text back."""
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    rows = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return byte_bpe.round_trip(rows, path, pattern, keep=("doc_id", "source", "digest")).select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]
# Learned scores, fingerprints and sorted suffixes are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
