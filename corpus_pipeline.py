"""From raw documents to token files, in five stages.

Each stage works on all rows that the stage before it kept. All but the last return the
columns of documents; the last returns a row a document of the files it has written. The
stages' edge cases (null ids and texts, repeated rows, empty tables) are those of the
operators they call.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fundweave.llm import decontam, mixing, simhash, tokenfile, toxicity
from fundweave.llm.staging import staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the severity at which toxicity rejects."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sample_rows=20_000, levels=2)
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles."""
    return simhash.dedup(docs, words=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of the benchmark occurs."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs, weights=(5, 2, 1), max_epochs=3, seed=42)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the token files."""
    path = public_tokenizers.path("word_bpe_49k.json")
    files, folder = tokenfile.token_output(docs, tokenizer_path=path, end_id=2)
    return tokenfile.document_digests(files, folder)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mix", mix_sources),
    ("token ids", write_token_ids),
]

#: Trained weights, hashes and a tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{i}")
    return docs
