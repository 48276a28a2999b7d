"""A training-data pipeline of five stages, each by one operator of ``loomfold.llm``.

quality rules -> near-duplicate removal -> secret redaction -> mixing to target weights -> encoding.
Every stage works on all rows that the one before kept; all but the last return the columns of
``documents``.  What a stage kept on the way is deleted when the next one starts, since its result
has been written by then.

Null and empty texts fail the quality rules, so later stages meet them only if called alone: they
are copies of nothing and stay, hold no secret, have no words to take, and no tokens.  Repeated rows
are one group.  Empty tables give empty ones.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomfold.lineage import keep, recorded, release
from loomfold.llm import bytebpe, fertility, mixing, neardup, secrets
from loomfold.llm.common import bounded_batches

#: Tables that the stage before kept on the way, by application.
_before: dict[str, list[str]] = {}


def _stage(fn):
    """The stage, which first deletes what the one before it kept: its result has been written by then."""
    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _before.pop(app, []), docs)
        with recorded() as paths:
            out = fn(spark, docs, sf_dir)
        _before[app] = paths
        return out
    return call


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fertility rules; the others go."""
    bounded_batches(spark, 1024)
    return fertility.accepted(docs.select(*COLUMNS))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group: shingles of five words, similarity 0.8 or more."""
    bounded_batches(spark, 1024)
    return neardup.deduplicated(docs.select(*COLUMNS))


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, ``n_chars`` of what is left."""
    bounded_batches(spark, 1024)
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of ids, digest of the decoded bytes, for every row."""
    bounded_batches(spark, 2048)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = F.col("ids")
    return bytebpe.encode(docs.select("doc_id", "text"), path, keep=["doc_id"]).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bytebpe.decode(ids, path), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near-duplicate removal", near_dedup), ("secret redaction", redact_secrets), ("mixing sources", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisers and label forests have no SQL form; tests/llm compares every stage with a plain version.
ORACLE_SQL = None
