"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names, for every operator, query and stage."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import chat, decontaminate, fingerprint, line_dedup, mixing, pii, queries, simhash, substring, toxicity, warc
from ledgerlake.session import shared_dir

LONG = "lorem ipsum dolor sit amet consectetur " * 6_000
TEXTS = [
    (1, "A line that is shared\nmore words here", "en", "src0"), (2, "a line that is SHARED\nother", "de", "src1"),
    (2, "a line that is SHARED\nother", "de", "src1"), (2, "another text with this id", "fr", None), (None, "no id at all", None, "src2"),
    (None, "no id at all", None, "src2"), (3, "", "es", ""), (4, None, "es", "src3"), (5, LONG, "en", "src4"), (6, " \n\t ", "xx", "src0"),
]
#: Names that operators use inside or add; all but the added ones must pass through.
CLASHING = ["id", "body", "row", "drop", "k", "h1", "h2", "first", "chunk", "bucket", "node", "root", "a", "b", "n", "text_hash", "keeper", "g", "tokens", "weight", "unknown", "fold", "toxic", "item"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "no id at all"), (1, None), (None, ""), (2, "more words here")], "item_id long, text string")


DOCUMENTS = {
    "imatch": lambda d, l, i: fingerprint.imatch(d),
    "edit": lambda d, l, i: fingerprint.edit_robustness(d),
    "substring": lambda d, l, i: substring.substring_dedup(d),
    "toxicity": lambda d, l, i: toxicity.score(d, toxicity.fit(d, l)),
    "simhash": lambda d, l, i: simhash.near_duplicates(d),
    "mix": lambda d, l, i: mixing.mix(d, {"src0": 0.5, "src1": 0.5}, {"en": 0.5, "de": 0.5}, {"prose": 1.0}),
    "contamination": lambda d, l, i: decontaminate.find_contamination(d, i),
    "decontaminate": lambda d, l, i: decontaminate.decontaminate(d, i),
    "pii": lambda d, l, i: pii.find_pii(d),
    "redact": lambda d, l, i: pii.redact(d),
    "lines": lambda d, l, i: line_dedup.line_dedup(d),
}
NARROW = {"edit", "substring", "simhash"}


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_one_result_for_each_row(docs, labels, items, name):
    got = DOCUMENTS[name](docs, labels, items)
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(t[0]) for t in TEXTS)
    if name not in NARROW:
        assert all(r[c] == f"extra {c}" for r in rows for c in CLASHING)


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_empty_table(docs, labels, items, name):
    assert DOCUMENTS[name](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


def test_defined_results(docs, labels, items):
    found = {(r["doc_id"], r["text"]): r for r in decontaminate.find_contamination(docs, items).collect()}
    assert found[None, "no id at all"]["items"] == ["1"] and found[4, None]["n_words"] == 0
    assert found[1, TEXTS[0][1]]["hit_spans"] == [[5, 8]]
    near = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert near[3]["fingerprint"] == near[4]["fingerprint"] == near[6]["fingerprint"] == 0 and near[6]["component_id"] == 3
    assert near[None]["component_id"] is None
    kept = simhash.deduplicate(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "2", "3", "5", "None"]
    assert len(kept[0].asDict()) == len(docs.columns)
    cut = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.substring_dedup(docs).collect()}
    assert cut[5, 36_000] == 36_000 and cut[4, 0] == 0
    scores = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(docs, None).collect()}
    assert set(scores.values()) == {0.0}


def test_queries_on_empty_tables(spark, tmp_path):
    for name, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_warc_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, None, "x" * 200), (None, "u", "x" * 200), (7, "u", "y" * 500), (7, "u", "y" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("extra")).withColumn("block", F.lit(1))
    path = shared_dir(spark, f"edge-warc-{uuid.uuid4().hex}")
    warc.write_warc(pages, path, segment_bytes=100)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == 6 and all(r["complete"] for r in got) and {r["record_type"] for r in got} == {"response"}
    assert sorted(r["payload_bytes"] for r in got) == [0, 0, 200, 200, 500, 500]


def test_chat_edges(spark):
    rows = [(None, 1, "a", "x"), (1, None, None, None), (1, 1, "", "t"), (1, 1, "", "t"), (2, 0, "system", "only"), (3, 0, "a\nb", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("name", "said", "part", "p")})
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(None, "a", 0), (1, "unknown", -1), (1, "unknown", 0), (3, "a b", 0)}
    assert got[1, "unknown", 0]["n_turns"] == 2 and len(got[1, "unknown", 0]["mask"]) == 2
    assert chat.rotate_perspectives(df.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, docs, stage):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    assert got.columns == docs.columns
    rows = got.collect()
    assert 0 < len(rows) <= len(TEXTS) and all(r[c] == f"extra {c}" for r in rows for c in CLASHING)
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), sf_dir).collect() == []
