"""A corpus pipeline: quality, near-duplicates, benchmark leaks, mixing and sharding, each stage on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import decontam, mixing, quality, sharding, simhash
from quillwork.llm.common import STASHES, forget, stash, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null texts are judged as empty ones, repeated and unnamed rows each by their
    text; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents whose five-word shingles are 0.8 similar or more, by SimHash. Texts without words
    are copies of each other; of rows that repeat a doc_id one stays; rows without a doc_id stay."""
    return simhash.keep_one_similar(docs, shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts, repeated and unnamed rows stay or go by their text."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources by their target shares. Null sources are pooled; no row is lost."""
    return mixing.mixed(docs, own_streams=True)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and mix_position: reading shards in its order keeps the target shares, however files are cut.
    Rows without a doc_id share a shard; columns named shard or like those of mixing are replaced."""
    mixed = mixing.mix(docs, own_streams=True)
    return sharding.assign_shards(mixed.drop(*[c for c in mixing.COLUMNS if c != "mix_position"]), sharding.equal_shards(24))


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mixing", mixed_sources), ("sharding", shards)]
#: A learnt classifier, 64-bit hashes and edit distances have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mine = table(spark, sf_dir, "documents"), len(STASHES)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        # what this stage wrote on its way and what it read are not needed any more
        forget(spark, STASHES[mine:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
