"""Benchmark decontamination: remove benchmark passages from documents.

The words of every benchmark item (A-Z lower-cased, runs of ASCII letters,
ASCII digits and all non-ASCII characters) are cut into windows of
``window`` consecutive words; an item of fewer words, but not none, is one
window. The windows are the broadcast table: a benchmark is a fixed test
set that does not grow with the corpus, and its size is checked before it
is sent: over ``max_windows`` the call fails and says so; scan
such a set in slices, one call for each.

Every task rolls over its documents' words, looks up the hash of each
window in the sorted window hashes, verifies each hit against the window's
words, and marks the words inside. Documents are not shuffled.

Defined results: null and empty texts have no words and no hits; null
items have no words; equal items under several ids all count; rows with the
same ``doc_id`` are judged each on its own; an empty benchmark or document
table gives no hits or no rows; other columns are passed through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import alnum_words, bounded_arrow, rolling, small_batches, spaced

WINDOW = 10
#: Windows sent to the executors at once (about 200 bytes each).
MAX_WINDOWS = 400_000

HIT_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def item_windows(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Window words to the ids (as strings) of the items that hold them."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            found[tuple(words[i : i + n])].add(str(item))
    return {w: sorted(ids) for w, ids in found.items()}


class WindowIndex:
    """Window hashes by length, and the windows behind each hash."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.windows = windows
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for w in windows:
            by_length[len(w)].append(w)
        #: A word's 64-bit hash; 0 stands for every word no window has.
        self.word_hash = {w: xxhash.xxh3_64_intdigest(w) | 1 for ws in windows for w in ws}
        self.hashes = {
            n: np.unique(np.array([rolling(self._hashed(w), n)[0] for w in ws], np.uint64))
            for n, ws in by_length.items()
        }

    def _hashed(self, words) -> np.ndarray:
        return np.fromiter(map(self.word_hash.get, words, repeat(0)), np.uint64, len(words))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Mask of the words inside a window's occurrence, and the items."""
        marks, items = np.zeros(len(words) + 1, np.int32), set()
        h = self._hashed(words)
        known = np.flatnonzero(h)
        if len(known):
            for n, hashes in self.hashes.items():
                if len(known) < n:
                    continue
                r = rolling(h, n)
                at = np.minimum(np.searchsorted(hashes, r), len(hashes) - 1)
                for i in np.flatnonzero(hashes[at] == r):
                    ids = self.windows.get(tuple(words[i : i + n]))
                    if ids:
                        marks[i] += 1
                        marks[i + n] -= 1
                        items.update(ids)
        return np.cumsum(marks[:-1]) > 0, items


def spans_of(mask: np.ndarray) -> list[list[int]]:
    """[start, end) of each run of set entries."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _scanner(index_of, names: list[str], schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for whole in batches:
            for batch in small_batches(whole):
                n_words, n_hit, found, spans = [], [], [], []
                for text in batch.column(names.index("text")).to_pylist():
                    words = alnum_words(text)
                    mask, items = index.hits(words)
                    n_words.append(len(words))
                    n_hit.append(int(mask.sum()))
                    found.append(sorted(items))
                    spans.append(spans_of(mask) if items else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(found, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    ],
                    schema=schema,
                )

    return scan


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids as strings,
    sorted) and ``hit_spans`` (word ranges). Input columns of these names
    are replaced. ``benchmark`` needs ``item_id`` and ``text``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_arrow(spark)
    windows = item_windows(_bounded_items(benchmark, window, max_windows), window)
    added = {f.name for f in HIT_FIELDS}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    out = T.StructType([*base.schema.fields, *HIT_FIELDS])
    sent = spark.sparkContext.broadcast(windows)
    built: list[WindowIndex] = []

    def index_of() -> WindowIndex:
        if not built:
            built.append(WindowIndex(sent.value))
        return built[0]

    return base.mapInArrow(_scanner(index_of, base.columns, to_arrow_schema(out)), out)


def _bounded_items(benchmark: DataFrame, window: int, max_windows: int) -> list[tuple[object, str | None]]:
    """The benchmark's rows, after a check that their windows fit."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = benchmark.agg(F.coalesce(F.sum(words), F.lit(0)).alias("n")).first()["n"]
    if total > max_windows:
        raise ValueError(
            f"the benchmark has up to {total} windows, over max_windows={max_windows}: "
            "call find_contamination on slices of it, or raise max_windows to what an executor holds"
        )
    return [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW
) -> DataFrame:
    """``docs`` without contamination. ``remove="documents"`` drops every
    document with a hit; ``remove="spans"`` cuts the hit words, with what
    stands between them, out of the text and keeps the rest."""
    found = find_contamination(docs, benchmark, window)
    if remove == "documents":
        return found.where("n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns if c in found.columns])
    if remove != "spans":
        raise ValueError("remove must be 'spans' or 'documents'")
    from pyspark.sql.pandas.types import to_arrow_schema

    names = found.columns
    kept = [c for c in docs.columns if c in names]
    out = T.StructType([found.schema[c] for c in kept])
    schema = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut_words(text, spans) if spans else text
                for text, spans in zip(
                    batch.column(names.index("text")).to_pylist(), batch.column(names.index("hit_spans")).to_pylist()
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else batch.column(names.index(c)) for c in kept],
                schema=schema,
            )

    return found.mapInArrow(cut, out)


def cut_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of each [start, end) range."""
    data = text.encode("utf-8")
    clean = spaced(text)
    bounds, at = [], 0
    for word in clean.split():
        at = clean.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    pieces, last = [], 0
    for start, end in spans:
        pieces.append(data[last : bounds[start][0]])
        last = bounds[end - 1][1]
    pieces.append(data[last:])
    return b"".join(pieces).decode("utf-8")

