"""A training corpus from the documents table in five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlepoint.llm import exact_dedup, mixing, ngram_join, packing, quality
from settlepoint.llm.common import delete_path, fresh_path, spare, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranking scores 0.7 or more; it learns as op2 does.

    Null and empty texts are scored like any other; repeated rows stay or go together.
    """
    learnable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    sample = quality.labelled_sample(table(spark, sf_dir, "labels"), learnable)
    model = quality.fit(docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("label_id")))
    (score,) = spare(docs.columns, "score")
    return quality.score(docs, model, name=score).where(F.col(score) >= 0.7).select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: one with the largest doc_id (a null text counts as empty, a null id as least)."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle similarity of 0.8 or more, one with the smallest doc_id stays.

    A row is told by its id and text, so that another text of a dropped id stays. Texts without words stay;
    rows that repeat both the id and the text of the one that stays (the stage before leaves none) stay too.
    """
    gone, gone_hash = spare(docs.columns, "gone", "gone_hash")
    dropped = ngram_join.jaccard_join(docs).where(~F.col("first")).select(F.col("doc_id").alias(gone), F.col("text_hash").alias(gone_hash)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(gone)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(gone_hash))
    return docs.join(dropped, same, "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source comes near its target (texts without words are in no mix: rate 0 or
    drawn like others of their source; a null source is a source of its own)."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, sketch and tokenise, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's output is deleted once the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    return docs
