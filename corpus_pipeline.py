"""A training-corpus pipeline: quality, toxicity, near-duplicates, decontamination, token ids.

STAGES lists (name, function).  Each function takes (spark, docs, sf_dir), works on
all rows that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``docs``:

1. quality: documents that the base rules or the line-frequency verdict reject go,
   and so do the lines above the limit in those that stay (n_chars follows, where
   ``docs`` has it);
2. toxicity: a classifier learns from the labelled documents that are left (labels
   whose id is held out excepted); documents that it calls toxic go;
3. near_duplicates: of each group of documents (five-word shingles, similarity 0.8)
   the one with the smallest id stays;
4. decontamination: documents that hold a benchmark window go;
5. token_ids: doc_id, the ids, their number, and digests of ids and decoded bytes.

Defined results: null and empty texts fail the quality rules and go; null hosts are
one host; a null id is never held out, nor the smallest of its group; rows that
repeat an id are judged by their own text in stages 1, 2, 4 and 5, and in stage 3
stay if their id does; columns of ``docs`` beside doc_id, text, source and n_chars
pass through the first four stages, whatever their names; an empty table gives an
empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, minhash, quality, toxicity
from tidemark.llm._shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality.filter_quality(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.filter_toxic(docs, toxicity.train(docs, labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_corpus(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("token_ids", token_ids_stage),
]

#: SQL cannot express the learned stage; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each read from what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
