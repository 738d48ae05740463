"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats
from .common import read
from .divergence_audit import audit_sources
from .license_scan import scan_licenses
from .minhash_near_dup import near_duplicates
from .packing import pack_documents
from .piece_sampling import round_trip
from .pivot_near_dup import embedding_near_duplicates
from .quality_gam import held_out, score_quality, train_quality
from .scaled_sketch import fingerprint_documents
from .secret_scan import scan_secrets
from .topk_search import top_inner_products
from .treap_search import rank_documents
from .url_filter import filter_urls


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_secret_scan, op3_embedding_near_dup, op4_topk_search, op5_piece_sampling,
        op6_packing, op7_chat_format, op8_url_filter, op9_quality_gam, op10_minhash_near_dup,
        op11_treap_search, op12_scaled_fingerprint, op13_divergence_audit,
    )}
