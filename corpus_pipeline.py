"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage works on all rows that the stage before kept. Documents of low quality go, one document of each group of near copies
stays, documents with leaked test items go, the rest is repeated or left out to meet the sources' targets, and the token ids
are written; the last stage returns where each document's ids are.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from depthspark.llm.common import new_path, release_memory, store, tune
from depthspark.llm.decontaminate import without_leaks
from depthspark.llm.knn_quality import fit, quality_scores
from depthspark.llm.mixing import mix, repeated
from depthspark.llm.ngram_join import one_of_each
from depthspark.llm.pitman_yor import remainder
from depthspark.llm.token_files import token_digest, write_tokens

LEAST_QUALITY = 0.3


def ready(spark: SparkSession) -> SparkSession:
    """The session with its settings; what the driver kept for the stage before goes back to the machine."""
    gc.collect()
    release_memory()
    return tune(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, fit(docs, labels, remainder("doc_id", 5) != 0))
    return scored.where(scored["quality_score"] >= LEAST_QUALITY).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), answer_share=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return repeated(docs, mix(docs))


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(ready(spark), "tokens")
    write_tokens(docs, path)
    return token_digest(spark, path)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("mix", mix_sources), ("tokens", write_ids)]
ORACLE_SQL = None   # classifier, rounding and token ids are beyond SQL; tests/llm compares the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
