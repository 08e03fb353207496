"""Secrets: rules for known shapes, character Markov models for the rest.

Three rules find known shapes: values assigned to password-like names,
access key ids, and long runs of hexadecimal digits. What no rule knows is
judged by two character models of order two, one of random strings and one
of ordinary identifiers: a token is reported if its characters are far
likelier under the first. Each model backs off from two characters of
context to one and to none, with ``BACKOFF`` pseudo-counts, and keeps a share
``FLOOR`` for any character, so that an unseen one is weak evidence alone.

The models are learned from labelled samples. ``labelled_samples`` takes
them from a corpus: random are the values that the rules found there, and
a digest of each text, written as hexadecimal, as base 64 and in upper-case
letters and digits, as keys are; ordinary are all other tokens that are not
plain numbers. Counts are
sums of the whole corpus; there are at most 67^3 for each class, whatever
its size, so the model is bounded by the alphabet and sent to each task.

A token is a run of ``A-Za-z0-9+/_-`` and ends before padding. It is judged
if it has ``MIN_CHARS`` characters or more, letters as well as digits, and
does not touch a span of the rules.

Defined results: null and empty texts have no secrets; rows are judged one
by one, so repeated rows give repeated rows and null ids stay null; without
labelled tokens of both classes only the rules report; an empty table gives
an empty result; other columns pass through, one called ``secrets`` is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import bounded_arrow, small_batches

BASE_KINDS = ("assign", "access", "hex")
#: Added to the base kinds; listed after them at the same start.
KINDS = (*BASE_KINDS, "random")

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")
_LONG_TOKEN = r"[A-Za-z0-9+/_-]{%d,}"
MIN_ASSIGNED, MIN_ACCESS = 8, 16

#: A token is judged from this length on, and learned from that on.
MIN_CHARS, LEARN_CHARS = 20, 8
#: Log-likelihood ratio for each character from which a token is reported.
THRESHOLD = 0.7
BACKOFF = 20.0
FLOOR = 0.05

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Codes: 0 stands for the start and end of a token.
_SIZE = len(_ALPHABET) + 1
_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(1, _SIZE)
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_COUNTS = "label int, gram int, n long"
_COUNTS_ARROW = pa.schema([("label", pa.int32()), ("gram", pa.int32()), ("n", pa.int64())])


@dataclass(frozen=True)
class Model:
    """``ratio``: log-likelihood of random over ordinary for each (two
    characters, next character); None without samples of both classes."""

    ratio: np.ndarray | None


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the rules' matches: code
    points, by start, then kind."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def _grams(tokens: list[str]) -> np.ndarray:
    """Every (two characters, next character) of the tokens as one number;
    a token stands between start marks and one end mark."""
    if not tokens:
        return np.empty(0, np.int64)
    codes = _CODES[np.frombuffer(("  " + "  ".join(tokens) + " ").encode("ascii"), np.uint8)].astype(np.int64)
    grams = (codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:]
    # Between tokens a gram that predicts the second start mark is no event.
    return grams[(codes[2:] != 0) | (codes[1:-1] != 0)]


def _free_tokens(text: str, spans: list[tuple[int, int, int, int]], pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens that touch no span."""
    taken = sorted((s, e) for s, _, e, _ in spans)
    out, at, reach = [], 0, -1
    for m in pattern.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def _count_corpus(batches: Iterator[pa.RecordBatch], column: int, learn_chars: int) -> Iterator[pa.RecordBatch]:
    """Gram counts of a task's texts, by label. The digests come with the
    rows, as Spark made them."""
    pattern = re.compile(_LONG_TOKEN % learn_chars)
    counts = np.zeros((2, _SIZE**3), np.int64)
    for whole in batches:
        for batch in small_batches(whole):
            ordinary, random = [], []
            for text, digests in zip(batch.column(column).to_pylist(), batch.column(column + 1).to_pylist()):
                random += digests
                spans = base_spans(text)
                for _, _, end, value in spans:
                    random += _TOKEN.findall(text[value:end])
                ordinary += [t for _, _, t in _free_tokens(text, spans, pattern) if not t.isdigit()]
            for label, tokens in enumerate((ordinary, random)):
                grams = _grams(tokens)
                if len(grams):
                    counts[label] += np.bincount(grams, minlength=_SIZE**3)
    for label in (0, 1):
        seen = np.flatnonzero(counts[label])
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), label, np.int32)), pa.array(seen.astype(np.int32)), pa.array(counts[label][seen])], schema=_COUNTS_ARROW
            )


def _count_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _SIZE**3), np.int64)
    for batch in batches:
        found: tuple[list, list] = ([], [])
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[label].extend(_TOKEN.findall(text))
        for label in (0, 1):
            grams = _grams(found[label])
            if len(grams):
                counts[label] += np.bincount(grams, minlength=_SIZE**3)
    for label in (0, 1):
        seen = np.flatnonzero(counts[label])
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), label, np.int32)), pa.array(seen.astype(np.int32)), pa.array(counts[label][seen])], schema=_COUNTS_ARROW
            )


def _digests() -> Column:
    """Random strings from a text: its SHA-256 in hexadecimal, in base 64
    and in upper-case letters and digits."""
    digest = F.sha2(F.col("text"), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    # Base 64 without its lower-case letters and marks, as key ids are written.
    upper = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("k"), F.col("text")), 512))), "[^A-Z0-9]", "")
    return F.array(F.substring(digest, 1, 40), base64, upper)


def probabilities(counts: np.ndarray) -> np.ndarray:
    """log p(c | ab) from gram counts: each order is smoothed by the next
    shorter one, the last by the alphabet."""
    n = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
    one = n.sum((0, 1))
    p = (one + 1.0) / (one.sum() + _SIZE)
    two = n.sum(0)
    p = (two + BACKOFF * p) / (two.sum(1, keepdims=True) + BACKOFF)
    p = (n + BACKOFF * p[None]) / (n.sum(2, keepdims=True) + BACKOFF)
    return np.log((1 - FLOOR) * p + FLOOR / _SIZE).ravel()


def _model(counts: DataFrame) -> Model:
    # At most 2 x 67^3 rows.
    rows = counts.groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, _SIZE**3))
    table[rows["label"].to_numpy(np.int64), rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    if not table.any(axis=1).all():
        return Model(None)
    return Model((probabilities(table[1]) - probabilities(table[0])).astype(np.float32))


def fit(docs: DataFrame, learn_chars: int = LEARN_CHARS) -> Model:
    """The models of the samples that the corpus itself labels."""
    bounded_arrow(docs.sparkSession)
    texts = docs.where("text IS NOT NULL AND text <> ''").select("text").withColumn("digests", _digests())
    return _model(texts.mapInArrow(lambda it: _count_corpus(it, 0, learn_chars), _COUNTS))


def fit_samples(samples: DataFrame) -> Model:
    """The models of given samples: ``text`` and ``label`` (1: random, 0:
    ordinary); rows with a null are left out."""
    rows = samples.where("text IS NOT NULL AND label IN (0, 1)").select("text", F.col("label").cast("int").alias("label"))
    return _model(rows.mapInArrow(_count_samples, _COUNTS))


def likelihood_ratio(token: str, model: Model) -> float:
    """Log-likelihood ratio of random over ordinary, for each character."""
    grams = _grams([token])
    return float(model.ratio[grams].sum(dtype=np.float64) / len(grams))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def find_spans(text: str | None, model: Model, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> list[dict]:
    """Spans of one text: the rules' matches (score 1) and the tokens whose
    ratio reaches the threshold (their ratio, with 1 as the most), by start,
    then kind."""
    text = text or ""
    base = base_spans(text)
    spans = [(s, kind, e, 1.0) for s, kind, e, _ in base]
    if model.ratio is not None and len(text) >= min_chars:
        for s, e, token in _free_tokens(text, base, re.compile(_LONG_TOKEN % min_chars)):
            if _mixed(token):
                score = likelihood_ratio(token, model)
                if score >= threshold:
                    spans.append((s, 3, e, min(1.0, round(score, 4))))
    return [{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(spans)]


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans replaced by their kind in angle brackets; of
    overlapping spans the first start wins and covers the others."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, model: Model, add, field: T.StructField, arrow: pa.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_arrow(docs.sparkSession)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != field.name or c == "text"])
    at = base.columns.index("text")
    kept = [i for i, c in enumerate(base.columns) if c != field.name]
    out = T.StructType([*[base.schema.fields[i] for i in kept], field])
    schema = pa.schema([*[to_arrow_schema(base.schema).field(i) for i in kept], pa.field(field.name, arrow)])
    model = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole):
                made = pa.array([add(t, model.value) for t in batch.column(at).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], made], schema=schema)

    return base.mapInArrow(work, out)


def find_secrets(docs: DataFrame, model: Model, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (needs ``text``) with ``secrets``: an array of (kind, start,
    end, score), code points, by start, then kind as in ``KINDS``."""
    field = T.StructField("secrets", T._parse_datatype_string(_SPAN))
    return _mapped(docs, model, lambda t, m: find_spans(t, m, threshold, min_chars), field, _SPAN_ARROW)


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind."""
    field = T.StructField("text", T.StringType())
    order = docs.columns
    return _mapped(docs, model, lambda t, m: masked(t, find_spans(t, m, threshold, min_chars)), field, pa.string()).select(*[F.col(f"`{c}`") for c in order])
