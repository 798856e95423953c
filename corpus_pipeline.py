"""The training corpus pipeline: five stages over ``documents``, each one of the operators in ``supplylens.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept; its result is written as Parquet and read again.  All but
the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supplylens.llm import common, decontaminate, jaccard_join, mixing, quality_rules, token_store
from supplylens.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that a quality rule rejects go."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on shingles of five words, similarity 0.8: of linked documents the one with the least id stays."""
    return jaccard_join.keep_one(spark, docs, width=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a test item go."""
    return decontaminate.clean(spark, docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every document as often as its source's target asks for (from never to three times)."""
    return mixing.mix(spark, docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token files, read again: doc_id, start, n_tokens, tokens.

    ``start`` counts the ids before a row in the order of ids; copies of a
    document that the mix took lie next to each other.
    """
    path = scratch_path(spark, "pipeline-tokens")
    token_store.write_tokens(spark, docs, path, token_store.tokenizer_definition())
    return token_store.read_tokens(spark, path)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing to target weights", mixed),
    ("token ids", tokenized),
]

#: Components of links, BM25 and a tokenizer aren't SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.land(spark, stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`run` with the ids of each row as one crc32 (unsigned, little-endian 32-bit integers)."""
    return token_store.checksums(run(spark, sf_dir))


def queries() -> dict:
    return {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
