"""The corpus pipeline: five stages over the ``documents`` table, each one of the
training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared checkpoint folder, reads it back as the next
stage's documents and deletes it when that stage is written.  All stages but the last return the columns of documents.
Filters judge row by row, also where doc_id is null or repeated; empty tables
pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontaminate, pii_tagger, piece_scan, quality_rank, simhash_dedup
from spendlens.llm.common import numbered, table
from spendlens.session import forget, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranking accepts."""
    model = quality_rank.train(docs, table(spark, sf_dir, "labels"))
    return quality_rank.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (of equal ids, the least text digest;
    null ids last), of every group of near copies."""
    rows, key = numbered(docs)
    groups = simhash_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), shingle=3, radius=2)
    groups = groups.select(F.col("doc_id").alias(key), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.sha2("text", 256).alias("digest"), key)
    first = (rows.select(key, rank.alias("rank")).join(groups, key).groupBy(groups["component_id"].alias("group"))
             .agg(F.min("rank").alias("rank")))
    others = materialize(groups.join(first.select(F.col("rank")[key].alias(key)), key, "left_anti").select(key), "pipeline-copies")
    return rows.join(others, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    return pii_tagger.redact(docs, pii_tagger.labelled_windows(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document by the parallel scan: doc_id, digest (of the text),
    part, n_tokens and ids (little-endian u32); long documents have several parts."""
    parts = piece_scan.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return parts.select("doc_id", "digest", "part", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("PII", pii),
          ("SentencePiece encoding", pieces)]

# Trained scores, XXH64 fingerprints and piece ids have no SQL form; the stages
# are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
        forget(docs)                            # the stage before is read no more
        docs = kept
    return docs
