"""Exact substring deduplication over fixed-block anchors.

A word is a run of characters other than ASCII whitespace. Every run of
``window`` words that occurs more than once, anywhere, is a repeat; words
inside a repeat are removed, all occurrences of it.

1. Anchors. Blocks of (window + 1) // 2 words at multiples of that length
   are the reference index: any window holds a whole one. Every rolling run
   of block length, of every text, probes the index.
2. Extension. A window around a run that met a reference block elsewhere is
   a candidate. Candidates are compared as whole windows, which is to
   extend the hit to both sides as far as a window reaches; overlapping
   repeated windows join to maximal exact repeats.

Documents are dealt into chunks of about ``chunk_chars``. A chunk sends
each distinct hash once, with a mark if it occurs there more than once, so
a passage in a third of all documents costs a bucket one entry for each
chunk, not one for each document. Hashes travel sorted, as compressed gaps,
cut into as many ranges (buckets) as there are chunks. A bucket answers
each chunk with what is repeated. No pairs are made, and nothing is
gathered by content. The texts are shuffled once; both later passes over
the chunks reuse that shuffle.

Anchor hashes are cut to as many bits as the corpus needs for few chance
hits (they only pick candidates). Windows are compared by 95 bits of hash.

Defined results: null and empty texts have no words; rows with the same
``doc_id`` are texts of their own and can repeat each other; a null
``doc_id`` is kept; texts under ``window`` words are never cut; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import (
    bucket_edges,
    groups_of,
    hashed_words,
    member_of,
    pack_sorted,
    parts_by_size,
    rolling,
    text_or_empty,
    unpack_sorted,
    window_starts,
)

WINDOW = 35
CHUNK_CHARS = 16_000_000

_SENT = "bucket int, chunk long, data binary, more binary"
_ANSWER = "chunk long, kind int, bucket int, data binary"
_KEPT = "doc_id long, n_words long, n_removed long, text string, removed array<array<bigint>>"
_ANCHOR, _WINDOW = 1, 2

_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


class _Chunk:
    """The hashed words of a chunk's texts."""

    def __init__(self, table: pa.Table, window: int, bits: int, buckets: int):
        self.window, self.block, self.bits, self.buckets = window, (window + 1) // 2, bits, buckets
        self.texts = table.column("text").to_pylist()
        self.words, self.offsets = hashed_words(self.texts)
        self.total = len(self.words)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash, cut to ``bits - 2`` bits, of each run of block length."""
        runs = rolling(self.words, self.block)
        starts = np.flatnonzero(window_starts(self.offsets, self.block, self.total))
        return starts, runs[starts] >> np.uint64(64 - (self.bits - 2))

    def anchors(self) -> np.ndarray:
        """Distinct run hashes, ascending, over two marks: 2 for more than
        one occurrence here, 1 for one at a reference block."""
        starts, runs = self.blocks()
        in_text = starts - np.repeat(self.offsets[:-1], np.diff(self.offsets))[starts]
        keys = np.sort((runs << np.uint64(2)) | (in_text % self.block == 0).astype(np.uint64))
        first = groups_of(keys >> np.uint64(2))
        if not len(first):
            return keys
        several = np.diff(np.append(first, len(keys))) > 1
        return np.bitwise_or.reduceat(keys, first) | (several.astype(np.uint64) << np.uint64(1))

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a repeated anchor: start, and by distinct
        window its key, its check (lowest bit: more than one here) and,
        for each start, which distinct window it is."""
        starts, runs = self.blocks()
        hit = np.zeros(self.total + 1, np.int64)
        hit[starts[member_of(runs, repeated)]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(window_starts(self.offsets, self.window, self.total))
        reach = self.window - self.block + 1
        at = at[before[at + reach] > before[at]]
        key = rolling(self.words, self.window)[at]
        check = rolling(self.words, self.window, second=True)[at] >> np.uint64(33)
        order = np.lexsort((check, key))
        key, check = key[order], check[order]
        first = groups_of(key, check)
        which = np.empty(len(at), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        several = (np.diff(np.append(first, len(at))) > 1).astype(np.uint64)
        return at, key[first], (check[first] << np.uint64(1)) | several, which

    def edges(self, keys: np.ndarray, bits: int) -> np.ndarray:
        return bucket_edges(keys, bits, self.buckets)


def _sent(chunk: int, keys: np.ndarray, edges: np.ndarray, more: np.ndarray | None) -> pa.Table:
    rows = [
        (b, chunk, pack_sorted(keys[i:j]), None if more is None else more[i:j].astype("<u4").tobytes())
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:]))
        if j > i
    ]
    return pa.Table.from_pydict(dict(zip(_SENT_ARROW.names, map(list, zip(*rows)))) if rows else {n: [] for n in _SENT_ARROW.names}, _SENT_ARROW)


def _answered(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_pydict(dict(zip(_ANSWER_ARROW.names, map(list, zip(*rows)))) if rows else {n: [] for n in _ANSWER_ARROW.names}, _ANSWER_ARROW)


def _slices(parts: list[np.ndarray]) -> list[slice]:
    ends = np.cumsum([0, *map(len, parts)])
    return [slice(i, j) for i, j in zip(ends[:-1], ends[1:])]


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """A bucket of anchor hashes: each chunk gets back those of its own that
    occur twice or more in all chunks, once of these at a reference block."""
    parts = [unpack_sorted(d) for d in table.column("data").to_pylist()]
    every = np.concatenate(parts)
    key = every >> np.uint64(2)
    order = np.argsort(key, kind="stable")
    first = groups_of(key[order])
    marks = (every & np.uint64(3))[order]
    count = np.add.reduceat(1 + (marks >> np.uint64(1)).astype(np.int64), first)
    block = np.bitwise_or.reduceat(marks, first) & np.uint64(1)
    good = np.empty(len(every), bool)
    good[order] = np.repeat((count > 1) & (block > 0), np.diff(np.append(first, len(every))))
    bucket = table.column("bucket")[0].as_py()
    rows = [
        (chunk, _ANCHOR, bucket, pack_sorted(key[s][good[s]]))
        for chunk, s in zip(table.column("chunk").to_pylist(), _slices(parts))
        if good[s].any()
    ]
    return _answered(rows)


def _repeated_windows(table: pa.Table) -> pa.Table:
    """A bucket of candidate windows: each chunk gets back a bit for each
    of those it sent, in their order: whether it occurs twice or more."""
    parts = [unpack_sorted(d) for d in table.column("data").to_pylist()]
    key = np.concatenate(parts)
    more = np.concatenate([np.frombuffer(d, "<u4") for d in table.column("more").to_pylist()])
    check = more >> 1
    order = np.lexsort((check, key))
    first = groups_of(key[order], check[order])
    count = np.add.reduceat(1 + (more & 1)[order].astype(np.int64), first)
    good = np.empty(len(key), bool)
    good[order] = np.repeat(count > 1, np.diff(np.append(first, len(key))))
    bucket = table.column("bucket")[0].as_py()
    rows = [
        (chunk, _WINDOW, bucket, np.packbits(good[s]).tobytes())
        for chunk, s in zip(table.column("chunk").to_pylist(), _slices(parts))
        if good[s].any()
    ]
    return _answered(rows)


def _anchors_of(answers: pa.Table) -> np.ndarray:
    rows = [
        (b, d)
        for k, b, d in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data")))
        if k == _ANCHOR
    ]
    return np.concatenate([unpack_sorted(d) for _, d in sorted(rows)]) if rows else np.empty(0, np.uint64)


def _covered(chunk: _Chunk, answers: pa.Table) -> np.ndarray:
    """Mask of the chunk's words that a repeated window covers."""
    cover = np.zeros(chunk.total + 1, np.int64)
    repeated = _anchors_of(answers)
    if len(repeated):
        at, key, _, which = chunk.candidates(repeated)
        edges = chunk.edges(key, 64)
        good = np.zeros(len(key), bool)
        for kind, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
            if kind == _WINDOW:
                i, j = edges[bucket], edges[bucket + 1]
                good[i:j] = np.unpackbits(np.frombuffer(data, np.uint8), count=j - i)
        at = at[good[which]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + chunk.window, -1)
    return np.cumsum(cover[:-1]) > 0


def _cut(chunk: _Chunk, ids: list, mask: np.ndarray) -> Iterator[tuple]:
    for doc_id, text, i, j in zip(ids, chunk.texts, chunk.offsets[:-1], chunk.offsets[1:]):
        words = text.encode("utf-8").split()
        gone = mask[i:j]
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
        if len(spans):
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        yield doc_id, int(j - i), int(gone.sum()), b" ".join(words).decode("utf-8"), spans.tolist()


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``text`` (kept words joined
    by one space) and ``removed`` (the maximal repeats as word ranges, end
    exclusive) for each row of ``docs`` (``doc_id``, ``text``)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chunks, total = parts_by_size(texts, F.octet_length("text"), chunk_chars)
    # Two bits are marks; the rest leaves about one chance hit in 500 probes
    # of an index as large as the corpus, far fewer at a block in 18 words.
    bits = min(64, max(32, total.bit_length() + 9 + 2))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)))
    args = (window, bits, chunks)

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        anchors = _Chunk(table, *args).anchors()
        return _sent(key[0].as_py(), anchors, bucket_edges(anchors, bits, chunks), None)

    def send_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _SENT_ARROW.empty_table()
        chunk = _Chunk(table, *args)
        _, keys, checks, _ = chunk.candidates(_anchors_of(answers))
        return _sent(key[0].as_py(), keys, chunk.edges(keys, 64), checks)

    kept_arrow = _kept_arrow()

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kept_arrow.empty_table()
        chunk = _Chunk(table, *args)
        mask = _covered(chunk, answers)
        rows = list(zip(*_cut(chunk, table.column("doc_id").to_pylist(), mask)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kept_arrow)], schema=kept_arrow)

    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_anchors, _SENT).groupBy("bucket").applyInArrow(_repeated_anchors, _ANSWER)
    windows = (
        by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, _SENT)
        .groupBy("bucket").applyInArrow(_repeated_windows, _ANSWER)
    )
    return by_chunk.cogroup(anchors.unionByName(windows).groupBy("chunk")).applyInArrow(cut, _KEPT)


def _kept_arrow() -> pa.Schema:
    return pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("text", pa.string()),
            ("removed", pa.list_(pa.list_(pa.int64()))),
        ]
    )
