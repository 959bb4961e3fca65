"""A training corpus from documents: toxic ones out, one of each near-duplicate group, secrets masked, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyline.llm import packing, secret_scan, shingles, toxicity
from storyline.llm.queries import read, tokenizer
from storyline.operators.durable import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labels that may be learned from."""
    model = toxicity.train(docs, toxicity.training_labels(read(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity of 0.8 or more, that of the least doc_id; SimHash and MinHash find the pairs."""
    return shingles.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("secret_scans", mask_secrets), ("best_fit_packing", pack)]

#: Stages learn models and hash by a function that SQL lacks; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
