"""A corpus from documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last keep the
columns of documents.  Empty tables, null texts and ids, and extra columns pass
through: toxicity and decontamination keep empty texts, deduplication keeps one
of each group and every empty document, the mix has no row for a document
without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmeter.llm import circulant_minhash, mixing, prefix_join, token_files, toxicity
from quillmeter.llm.common import saved, work_dir


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return circulant_minhash.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return prefix_join.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents are repeated, cut or left out."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written and read back: doc_id, start, n_tokens, ids_crc32."""
    blocks = token_files.write_tokens(docs, token_files.default_tokenizer(), f"{work_dir(spark, 'tokens')}/blocks")
    return token_files.read_digests(blocks)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mix_sources),
    ("token_ids", token_output),
]

#: Signatures, permutations and the tokenizer cannot be said in SQL; tests/llm holds brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
