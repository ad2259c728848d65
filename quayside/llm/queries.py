"""The registered queries of the corpus operators: query name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (
    compact_windows, cross_entropy, dart_minhash, language_id, licence_scan, merkle_manifest, pareto_mix, piece_codec, reshard, subspace_join, syncmers,
    token_alignment, url_filter,
)
from quayside.llm.oracles import MANIFEST_SQL, MIX_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: piece ids of every whole text, and whether they decode to it."""
    out = piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id", "text"])
    return out.select("doc_id", "n_tokens", "ids", out["decoded"].eqNullSafe(out["text"]).alias("round_trip"))


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score: all documents against those of quality 1."""
    return cross_entropy.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: the mix of all documents."""
    out = pareto_mix.mix(table(spark, sf_dir, "documents"), pareto_mix.repeating_weight())
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return subspace_join.linked_vectors(table(spark, sf_dir, "embeddings"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, first_doc_id, start_word, end_word, first_start, first_end: passages that an earlier document has."""
    found = compact_windows.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("first_id", "first_doc_id")


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, loss of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept: near-duplicate classes of all documents."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, levels of every document."""
    return merkle_manifest.verified(table(spark, sf_dir, "documents"), merkle_manifest.newlines_deleted())


def op12_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved: from 12 shards by source to 16 of equal bytes."""
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(reshard.OLD_SHARDS))
    out = reshard.reshard(table(spark, sf_dir, "documents"), old)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256 of every document."""
    return token_alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_piece_codec, op2_cross_entropy, op3_pareto_mix, op4_subspace_join, op5_compact_windows,
        op6_syncmers, op7_url_filter, op8_licence_scan, op9_language_id, op10_dart_minhash,
        op11_merkle_manifest, op12_flow_reshard, op13_token_alignment,
    )
}
ORACLE_SQL = {"op3_pareto_mix": MIX_SQL, "op11_merkle_manifest": MANIFEST_SQL}
