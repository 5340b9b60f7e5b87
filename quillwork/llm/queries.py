"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, gridjoin, linkgraph, lm, lookup, mixing, quality, rules, secrets, sharding, simhash, toxicity, whitening
from .common import table


def op1_rendezvous_sharding(spark, sf_dir):
    """A row for each document; null texts count as empty, rows of a null or repeated doc_id stay, an empty table gives none."""
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op2_multipart_secrets(spark, sf_dir):
    """A row for each document; null texts have no spans, repeated rows stay, an empty table gives none."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_epsilon_grid_join(spark, sf_dir):
    """A row for each vector; null or non-finite ones link with nothing, repeated rows stay, an empty table gives none."""
    return gridjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_elias_fano_lm(spark, sf_dir):
    """A row for each document; null texts have one token, their end, repeated rows stay, an empty table gives none."""
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark, sf_dir):
    """A row for each document; null texts are scored as empty ones, repeated rows stay, an empty table gives none."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_tiles(spark, sf_dir):
    """A row for each document; null texts have fingerprint zero, repeated rows stay, an empty table gives none."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_cgk_decontamination(spark, sf_dir):
    """A row for each document and item in it; null texts have none, repeated rows are reported each, empty tables give none."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_link_propagation(spark, sf_dir):
    """A row for each page; null urls fit no rule and are allowed, repeated rows stay, an empty table gives none."""
    return linkgraph.judge_urls(table(spark, sf_dir, "pages"))


def op9_factorization_toxicity(spark, sf_dir):
    """A row for each document; null texts are scored as texts without terms, repeated rows stay, an empty table gives none."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pfair_mixing(spark, sf_dir):
    """A row for each document; null sources are a stream, repeated rows stay, an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    # the hash of the text tells rows without an id apart
    mixed = mixing.mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash")), own_streams=True)
    return mixed.select("doc_id", "source", "mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def op11_adaptive_rules(spark, sf_dir):
    """A row for each document; null texts count as empty, an empty table gives none."""
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op12_block_whitening(spark, sf_dir):
    """Up to 32 rows for each vector without null or non-finite entries; an empty table gives none."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lookup_clustering(spark, sf_dir):
    """A row for each vector of 64 finite components; an empty table gives none."""
    return lookup.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    """The documents that all stages keep, with shard and mix_position; stages say what they do with null and repeated rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding, op2_multipart_secrets, op3_epsilon_grid_join, op4_elias_fano_lm, op5_pu_quality, op6_simhash_tiles,
        op7_cgk_decontamination, op8_link_propagation, op9_factorization_toxicity, op10_pfair_mixing, op11_adaptive_rules, op12_block_whitening, op13_lookup_clustering, pipeline,
    )
}
#: The others cannot be said in SQL: each rests on a hash, model, iteration or rank that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op11_adaptive_rules": rules.ORACLE_SQL, "op13_lookup_clustering": lookup.oracle_sql()}
