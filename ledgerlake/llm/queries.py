"""The registered queries of this package: each applies one operator with
its production parameters to its whole table and derives digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    chat, clustering, decontaminate, fingerprint, line_dedup, mixing, pii, prefix_trie, secret_scan, simhash, substring, toxicity, warc,
)
from ledgerlake.llm.common import text_or_empty
from ledgerlake.session import shared_dir
from ledgerlake.sources.tables import read_table

#: Target shares of tokens. One source holds a third of the documents; it
#: is to hold a fifth of the tokens, the others share the rest alike.
SOURCE_TARGETS = {"src0": 0.20, **{f"src{i}": 0.80 / 19 for i in range(1, 20)}}
LANG_TARGETS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}
TOPIC_TARGETS = {"prose": 0.80, "legal": 0.05, "contact": 0.10, "noise": 0.05}


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_robustness(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = toxicity.pack(docs)
    model = toxicity.fit(packed, read_table(spark, sf_dir, "labels"))
    scored = toxicity.scores(packed, model)
    packed.release()
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, tokens, keep probability and draw, at
    the fixed share and sweeps of the query's SQL."""
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, SOURCE_TARGETS, LANG_TARGETS, TOPIC_TARGETS, mixing.KEEP_SHARE, mixing.SWEEPS)
    return mixed.select(
        "doc_id", *mixing.MARGINS, "mix_tokens", F.round("keep_p", 9).alias("keep_p"), "kept"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, f"warc-{uuid.uuid4().hex}")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select(
        warc.page_id_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id_of(F.col("refers_to")).alias("refers_to"),
        "complete",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    found = pii.find_pii(docs)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in pii.BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return rows.select(
        "conv_id", "perspective", "part", "n_turns", "rendered", F.array_join(spans, ",").alias("mask")
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(read_table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(digits, 256).alias("centroid_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.shared_prefixes(read_table(spark, sf_dir, "conversations"))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in secret_scan.BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_imatch": op1_imatch,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_decontaminate": op6_decontaminate,
        "op7_warc": op7_warc,
        "op8_pii": op8_pii,
        "op9_line_dedup": op9_line_dedup,
        "op10_chat": op10_chat,
        "op11_clusters": op11_clusters,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_secrets": op13_secrets,
    }
