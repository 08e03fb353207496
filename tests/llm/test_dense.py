"""Texts dense with matches or dropped lines, and crowds of near copies: the
work must not grow with the square of a text or crowd into a bucket."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import line_dedup, pii, simhash
from tests.llm import brute

DENSE = {
    "email": "someone.{0}@mail{0}.example.org, ",
    "ip": "host 10.{1}.3.{1} ü ",
    "card": "card 4111 1111 1111 1111; ",
    "phone": "call +49 30 1234{2:04d} x ",
    "iban": "IBAN DE89370400440532013000 BIC ",
}
MB = 1_000_000


def dense(kind: str, size: int) -> str:
    piece = DENSE[kind]
    out = "".join(piece.format(i, i % 256, i % 10_000) for i in range(size // len(piece.format(0, 0, 0)) + 1))
    return out[:size]


@pytest.mark.parametrize("kind", sorted(DENSE))
def test_dense_texts_take_linear_time(spark, kind):
    text = dense(kind, MB)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.find_pii(docs.limit(0)).collect()
    start = time.monotonic()
    spans = pii.find_pii(docs, (kind,)).first()["pii"]
    cut = pii.redact(docs, kinds=(kind,)).first()["text"]
    assert time.monotonic() - start < 90
    assert len(spans) > MB // 60
    assert all(text[s["start"]:s["end"]] == s["match"] for s in spans)
    assert spans == sorted(spans, key=lambda s: s["start"])
    plain, at = [], 0
    for s in spans:
        plain += [text[at:s["start"]], f"<{kind}>"]
        at = s["end"]
    assert cut == "".join(plain) + text[at:]


def test_context_reaches_over_earlier_matches(spark):
    # "call" stands 40 code points or less before the second number, with a match between.
    docs = spark.createDataFrame([(1, "call +49 30 123456, +49 30 654321 and much later in the text, +49 30 111111")], "doc_id long, text string")
    spans = pii.find_pii(docs, ("phone",)).first()["pii"]
    assert [s["score"] for s in spans] == [0.8, 0.8, 0.6]


def test_redact_overlapping_spans(spark):
    rows = [(1, "x 4111 1111 1111 1111@mail.org y +49 30 1234567 z"), (2, None), (3, ""), (4, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "x <card> y <phone> z", 2: None, 3: "", 4: "nothing"}


def test_many_dropped_lines(spark):
    lines = [f"line number {i} of a long text" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(reversed(lines))), (3, "\n".join(["only here, so it stays", *lines[::7], "short"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert time.monotonic() - start < 90
    assert got[1]["n_dropped"] == 0 and got[2]["n_dropped"] == 60_000
    assert got[3]["text"] == "only here, so it stays\nshort"
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.values()) == sorted(brute.line_dedup(rows))


def test_a_crowd_of_near_copies_spreads_over_buckets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    bits = np.uint64(1) << rng.integers(0, 64, (2_000, 3), dtype=np.uint64)
    crowd = np.unique(base ^ bits[:, 0] ^ bits[:, 1] ^ bits[:, 2])
    batch = pa.RecordBatch.from_arrays([pa.array(crowd.view(np.int64))], names=["fingerprint"])
    sizes: dict[int, int] = {}
    for out in simhash._variants(iter([batch]), 211):
        for row in out.to_pylist():
            sizes[row["bucket"]] = sizes.get(row["bucket"], 0) + len(row["flips"]) // 2
    assert len(sizes) == 211 and max(sizes.values()) < 0.02 * sum(sizes.values())
