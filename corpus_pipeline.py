"""Corpus pipeline: filter, deduplicate, decontaminate and mix documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes each stage's rows as Parquet into the shared
folder and reads them again, so a lost executor costs at most one stage.

1. toxicity: documents that the model rejects go. The model is learned from
   the labels of the stage's own documents.
2. line_dedup: lines that repeat across documents stay in one of them.
3. near_dedup: one document of each group of near duplicates stays.
4. decontaminate: documents with a benchmark passage go.
5. mix: documents are drawn to the target weights of sources, languages and
   topics.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns are
treated as each operator's docstring says; a stage keeps the columns of its
input (the last too). Rows without an id or text pass the filters like
others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, line_dedup, mixing, queries, simhash, toxicity
from ledgerlake.session import shared_dir
from ledgerlake.sources.tables import read_table



def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    packed = toxicity.pack(docs.select("doc_id", "text"))
    model = toxicity.fit(packed, read_table(spark, sf_dir, "labels"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = toxicity.score(marked, model, packed=packed).where("predicted = 0")
    packed.release()
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one keeps; ``n_chars``
    follows the text."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    cleaned = line_dedup.line_dedup(marked)
    new = {"text": F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.deduplicate(docs)


def decontaminate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = decontaminate.find_contamination(marked, read_table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, half of all tokens."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source", "lang")
    drawn = mixing.mix(marked, queries.SOURCE_TARGETS, queries.LANG_TARGETS, queries.TOPIC_TARGETS, budget=mixing.KEEP_SHARE)
    return drawn.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_filter),
    ("mix", mix),
]

#: Toxicity scores and XXH64 fingerprints can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    base = shared_dir(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
