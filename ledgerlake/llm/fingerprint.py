"""I-Match document fingerprints over randomised lexicon subsets.

Terms are lower-cased runs of ASCII letters, digits and non-ASCII
characters. The lexicon keeps the terms whose inverse document frequency
ln(N / df) lies in a band, counted over all documents; terms are told apart
by 64-bit hashes. A text's distinct lexicon terms are sorted, and for each of 64 random subsets of the lexicon
the run of those terms that are in the subset is hashed to 16 bits; a
subset that the text has no term of gives 0. Subsets come in five sizes,
from a half of the lexicon to one 512th: large ones break at any change,
small ones survive when half of the text is new. The likeness of two
fingerprints is the share of equal hashes among the subsets that at least
one of both has terms of (equal fingerprints: 1).

A term in the band has a document frequency of at least N * exp(-max_idf),
so the lexicon has at most (mean distinct terms of a document) *
exp(max_idf) entries, however many documents there are: it is collected
and broadcast. Membership in a subset is a hash of the term.

Defined results: null and empty texts, and others without a term, have the
fingerprint of zeros; a text with fewer than ``min_terms`` lexicon terms is
fingerprinted by all its distinct terms; equal texts have equal
fingerprints; repeated rows each have theirs; an empty table gives an empty
result. For the next document, a null ``doc_id`` comes first, and rows with
the same ``doc_id`` are ordered by a hash of the text; a single row's next
document is itself.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import WordHashes, alnum_words, bounded_arrow, parts_by_size, small_batches, text_or_empty

MIN_IDF = 2.3
MAX_IDF = 7.6
MIN_TERMS = 8
#: How many subsets keep a term with which probability (as a power of 1/2).
SUBSETS = ((2, 1), (6, 3), (14, 5), (20, 7), (22, 9))
#: Distinct terms a task counts before it hands them on.
TASK_TERMS = 500_000
BUCKET_CHARS = 16_000_000

_DF = "term long, df long"
_DF_ARROW = pa.schema([("term", pa.int64()), ("df", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task by term; handed on in parts, so that the
    counter stays bounded."""
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(set(alnum_words(text.as_py())))
        if len(counts) > TASK_TERMS:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(_hashed(counts).view(np.int64)), pa.array(counts.values(), pa.int64())], schema=_DF_ARROW
    )


def _hashed(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> np.ndarray:
    """The hashes of the terms of ``docs.text`` in the band, sorted."""
    bounded_arrow(docs.sparkSession)
    n = docs.count()
    low, high = n * math.exp(-max_idf), n * math.exp(-min_idf)
    per_term = docs.select("text").mapInArrow(_count_terms, _DF).groupBy("term").agg(F.sum("df").alias("df"))
    band = per_term.where(F.col("df").between(math.ceil(low), math.floor(high))).select("term")
    return np.sort(np.array([r["term"] for r in band.toLocalIterator()], np.int64).view(np.uint64))


class Subsets:
    """Which subsets each term is in, and hashes of texts by subset."""

    def __init__(self, terms: np.ndarray, min_terms: int = MIN_TERMS):
        self.powers = np.repeat([p for _, p in SUBSETS], [n for n, _ in SUBSETS])
        self.terms, self.min_terms = terms, min_terms
        self.member = self._membership(terms)
        self.hashes = WordHashes()

    def _membership(self, terms: np.ndarray) -> np.ndarray:
        """A bit for each subset that a term is in."""
        member = np.zeros(len(terms), np.uint64)
        draw = terms
        for k, power in enumerate(self.powers.tolist()):
            # A multiplicative generator, seeded by the term, of which the
            # highest bits decide: all zero with probability 1 / 2^power.
            draw = draw * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            mixed = draw ^ (draw >> np.uint64(29))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            member |= ((mixed >> np.uint64(64 - power)) == 0).astype(np.uint64) << np.uint64(k)
        return member

    def _terms_of(self, text: str | None) -> np.ndarray:
        """Hashes of the distinct terms, sorted."""
        terms = set(alnum_words(text))
        if len(self.hashes) > TASK_TERMS:
            self.hashes.clear()
        return np.sort(np.fromiter(map(self.hashes.__getitem__, terms), np.uint64, len(terms)))

    def fingerprint(self, text: str | None) -> np.ndarray:
        own = self._terms_of(text)
        out = np.zeros(len(self.powers), "<u2")
        at = np.minimum(np.searchsorted(self.terms, own), max(len(self.terms) - 1, 0))
        found = self.terms[at] == own if len(self.terms) else np.zeros(len(own), bool)
        if found.sum() >= self.min_terms:
            own, member = own[found], self.member[at[found]]
        else:
            member = self._membership(own)
        if len(own):
            inside = (member[None, :] >> np.arange(len(out), dtype=np.uint64)[:, None]) & np.uint64(1) == 1
            for k in np.flatnonzero(inside.any(axis=1)).tolist():
                out[k] = xxhash.xxh3_64_intdigest(own[inside[k]].tobytes(), k) % 65_535 + 1
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets that a or b has terms of."""
    if (a == b).all():
        return 1.0
    present = (a | b) > 0
    return float(((a == b) & present).sum() / present.sum())


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def imatch(docs: DataFrame, terms: np.ndarray | None = None, min_terms: int = MIN_TERMS) -> DataFrame:
    """``docs`` with ``fingerprint``, by the lexicon ``terms`` (default:
    that of ``docs``). An input column of this name is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_arrow(spark)
    sent = spark.sparkContext.broadcast(lexicon(docs) if terms is None else terms)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"])
    out = T.StructType([*base.schema.fields, T.StructField("fingerprint", T.StringType())])
    schema, at = to_arrow_schema(out), base.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets = Subsets(sent.value, min_terms)
        for whole in batches:
            for batch in small_batches(whole):
                made = [as_text(subsets.fingerprint(t)) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], schema=schema)

    return base.mapInArrow(add, out)


_PLACED = "bucket long, guest boolean, doc_id long, text string, text_hash long"
_PLACED_ARROW = pa.schema(
    [("bucket", pa.int64()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string()), ("text_hash", pa.int64())]
)
_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDITED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def edited_by_next(text: str, following: str) -> str:
    """``text`` whose last floor(n / 2) code points give way to the first
    as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_robustness(docs: DataFrame, terms: np.ndarray | None = None, min_terms: int = MIN_TERMS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """How a fingerprint changes when half of a text does: for each row of
    ``docs`` (``doc_id``, ``text``), its fingerprint, that of the text
    edited with the next document's beginning, and the likeness to that and
    to the next document's own.

    Rows are dealt into ranges of ``doc_id`` between quantiles, so texts are
    shuffled once. The first row of each range is also sent, as a guest, to
    the range before it, whose last row needs it (the first of all to the
    last range). At most one guest leaves a task for each range.
    """
    spark = docs.sparkSession
    known = lexicon(docs) if terms is None else terms
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ranges, _ = parts_by_size(texts, F.octet_length("text"), bucket_chars)
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = texts.agg(F.percentile_approx("doc_id", shares, 10_000).alias("at"), F.min("doc_id").alias("least")).first()
    # A range starts at each cut; nulls, or else the least id, start the first.
    nulls = bool(texts.where("doc_id IS NULL").take(1))
    least = cuts["least"]
    starts = sorted({x for x in cuts["at"] or () if x != least or nulls})
    firsts = [None if nulls else least, *starts]
    sent = spark.sparkContext.broadcast(known)
    edges = np.asarray(starts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guests: dict[int, tuple] = {}
        starting = {x: i for i, x in enumerate(firsts)}
        for whole in batches:
            for batch in small_batches(whole):
                rows = []
                for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
                    bucket = 0 if doc_id is None else int(np.searchsorted(edges, doc_id, side="right"))
                    row = (doc_id, text, text_hash)
                    rows.append((bucket, False, *row))
                    i = starting.get(doc_id)
                    if i is not None and (i not in guests or text_hash < guests[i][2]):
                        guests[i] = row
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACED_ARROW)], schema=_PLACED_ARROW)
        if guests:
            rows = [((i - 1) % len(firsts), True, *row) for i, row in guests.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACED_ARROW)], schema=_PLACED_ARROW)

    def judge(table: pa.Table) -> pa.Table:
        subsets = Subsets(sent.value, min_terms)
        key = lambda r: (r[0] is not None, r[0] or 0, r[2])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "text_hash", "guest"))))
        own = sorted((r for r in rows if not r[3]), key=key)
        out = []
        if own:
            following = [*own[1:], min((r for r in rows if r[3]), key=key)]
            mark = subsets.fingerprint(own[0][1])
            for (doc_id, text, _, _), after in zip(own, following):
                edited = edited_by_next(text, after[1])
                changed, next_mark = subsets.fingerprint(edited), subsets.fingerprint(after[1])
                out.append((
                    doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), as_text(mark), as_text(changed),
                    likeness(mark, changed), likeness(mark, next_mark),
                ))
                mark = next_mark
        columns = zip(*out) if out else [[] for _ in _EDITED_ARROW]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED_ARROW)], schema=_EDITED_ARROW)

    return texts.mapInArrow(place, _PLACED).groupBy("bucket").applyInArrow(judge, _EDITED)
