"""Toxicity by class-conditional Kneser-Ney models.

Two letter models, of toxic and of ordinary documents, read each word
(lower-cased runs of ASCII letters, digits and non-ASCII characters, as
bytes between boundary marks) with 5-grams, by interpolated Kneser-Ney: the
fifth order has a class's counts of texts, orders 3 and 4 its continuation
counts (plain ones where the n-gram begins at the word's begin). What is
discounted goes to one backoff distribution that both classes share: orders
1 and 2 by continuation counts over both. A rare expression therefore has
the same probability in both and says nothing. A word counts once for each
distinct text that holds it, so that copies do not count again. Words are
read one by one: a phrase of ordinary words is no evidence.

A word's evidence is its log-likelihood ratio, at most ``CLIP`` either way.
A document is scored by the length-normalised difference of its two
log-likelihoods, the part of it that words with a ratio above ``DECISIVE``
give, and the logarithm of its length; a logistic regression turns these
into a probability. It is fitted on a calibration sample, of each class a
fifth of the texts, at most about ``calibration_rows`` in all (chosen by a
hash of the text), by counts that have not seen it; the counts that score
documents are then of all training texts. A class of a single text has it
in both.

Scale: ``pack`` reads the texts once and writes them as bags of words, each
task in chunks of about ``CHUNK_BYTES`` with a vocabulary of their own, into
a table bucketed by chunk. Counting, sampling and scoring read that table
and shuffle no text. Every count is kept, as a Spark table; each chunk asks
for its distinct 5-grams, whose ratios are worked out once for the whole
corpus, by the two bytes before the last (a group bounded by the alphabet).
What a task holds is bounded by a chunk, and nothing that grows with the
corpus is collected or broadcast: only the shared orders 1 and 2 are, at
most 65,536 pairs of bytes. The tables stay in the shared folder.

Defined results: null and empty texts have no words and get the score of
a length of zero; a null ``doc_id`` is not held out and has no label; a
document with several labels is toxic if one says so, null labels count
for nothing; equal texts get equal scores; without a training row of
both classes every score is 0.0; an empty table gives an empty result;
other columns pass through. A single text must fit a task.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import alnum_words, bounded_arrow, pack_sorted, shuffle_partitions, small_batches, text_or_empty, unpack_sorted
from ledgerlake.session import shared_dir

ORDER = 5
#: Highest order of the backoff that both classes share.
SHARED = 2
DISCOUNT = 0.75
CLIP = 50.0
DECISIVE = 3.0
CALIBRATION_ROWS = 20_000
#: At most one training text in so many is chosen for calibration.
CALIBRATION_FOLD = 5
#: Partitions of the calibration sample.
SAMPLE_PARTS = 8
THRESHOLD = 0.7
#: Entries that a task holds before it hands counts on, or closes a chunk.
TASK_ENTRIES = 400_000
#: Bytes of text in a chunk, and documents, at most.
CHUNK_BYTES, CHUNK_ROWS = 32_000_000, 200_000

_COUNTED = "part int, item binary, n long"
_COUNTED_ARROW = pa.schema([("part", pa.int32()), ("item", pa.binary()), ("n", pa.int64())])
_ASKED = "chunk long, g binary"
_ASKED_ARROW = pa.schema([("chunk", pa.int64()), ("g", pa.binary())])
_RATIOS_ARROW = pa.schema([("g", pa.binary()), ("ratio", pa.float64())])
_SAMPLE_ARROW = pa.schema([("toxic", pa.int32()), ("text", pa.string())])
_BEGIN, _END = b"\x01", b"\x02"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def grams(word: bytes) -> list[bytes]:
    """The 5-grams of a word that end at its letters or its end."""
    padded = _BEGIN * (ORDER - 1) + word + _END
    return [padded[i - ORDER + 1 : i + 1] for i in range(ORDER - 1, len(padded))]


class _Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


@dataclass
class Packed:
    """Texts as bags of words: rows (chunk, at, doc_id, h1, h2, data), with
    ``data`` the sorted numbers of a text's words, or, where ``at`` is -1,
    the words of the chunk in the order of their numbers."""

    rows: DataFrame
    table: str

    def release(self) -> None:
        """Forget the table; its files stay in the shared folder."""
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def _text_keys() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text_or_empty()), F.xxhash64(F.lit("text"), text_or_empty())]


def _bags(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2, text) rows to those of ``Packed``."""
    task, closed = TaskContext.get().partitionId() << 32, 0
    words, size, at = _Numbers(), 0, 0

    def vocabulary() -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(level=1).compress(b" ".join(words))
        return pa.RecordBatch.from_pylist([{"chunk": task + closed, "at": -1, "data": data}], schema=schema)

    for whole in batches:
        for batch in small_batches(whole):
            data = []
            for text in batch.column(3):
                found = alnum_words(text.as_py())
                numbers = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
                numbers.sort()
                data.append(pack_sorted(numbers) if found else b"")
            n = batch.num_rows
            arrays = [pa.array([task + closed] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), *batch.columns[:3], pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            size, at = size + batch.nbytes, at + n
            if size > CHUNK_BYTES or at > CHUNK_ROWS or len(words) > TASK_ENTRIES:
                yield vocabulary()
                words, size, at, closed = _Numbers(), 0, 0, closed + 1
    if at:
        yield vocabulary()


def pack(docs: DataFrame) -> Packed:
    """``docs`` (``text``, and ``doc_id`` if there is one) as bags of words,
    in a table bucketed by chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_arrow(spark)
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    h1, h2 = _text_keys()
    narrow = docs.select(doc_id.alias("doc_id"), h1.alias("h1"), h2.alias("h2"), text_or_empty().alias("text"))
    kept = [T.StructField(f.name, f.dataType) for f in narrow.schema.fields[:3]]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("at", T.IntegerType()), *kept, T.StructField("data", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    table = f"bags_{uuid.uuid4().hex}"
    made = narrow.mapInArrow(lambda it: _bags(it, arrow), schema)
    made.write.bucketBy(shuffle_partitions(docs), "chunk").option("path", shared_dir(spark, table)).saveAsTable(table)
    return Packed(spark.table(table), table)


def _opened(chunk: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """The words of a chunk, its rows' numbers by ``at``, and where the row
    of each ``at`` stands."""
    order = np.argsort(chunk["at"].to_numpy())
    data = chunk["data"].to_pylist()
    words = zstandard.ZstdDecompressor().decompress(data[order[0]]).split()
    bags = [unpack_sorted(data[i]).astype(np.int64) if data[i] else np.empty(0, np.int64) for i in order[1:]]
    return words, bags, order[1:]


def _counted_chunk(chunk: pa.Table, rows: pa.Table) -> pa.Table:
    """Texts by part and word of the ``rows`` (chunk, at, part)."""
    out = []
    if rows.num_rows:
        words, bags, _ = _opened(chunk)
        at, parts = rows["at"].to_numpy(), rows["part"].to_numpy()
        for part in np.unique(parts).tolist():
            counts = np.zeros(len(words), np.int64)
            for i in at[parts == part].tolist():
                counts[np.unique(bags[i])] += 1
            seen = np.flatnonzero(counts)
            arrays = [pa.array([part] * len(seen), pa.int32()), pa.array([words[i] for i in seen], pa.binary()), pa.array(counts[seen])]
            out.append(pa.Table.from_arrays(arrays, schema=_COUNTED_ARROW))
    return pa.concat_tables(out) if out else _COUNTED_ARROW.empty_table()


def _sampled_chunk(chunk: pa.Table, rows: pa.Table) -> pa.Table:
    """The words of the ``rows`` (chunk, at, toxic) as texts."""
    out = []
    if rows.num_rows:
        words, bags, _ = _opened(chunk)
        for at, toxic in zip(rows["at"].to_pylist(), rows["toxic"].to_pylist()):
            out.append({"toxic": toxic, "text": b" ".join([words[i] for i in bags[at].tolist()]).decode()})
    return pa.Table.from_pylist(out, schema=_SAMPLE_ARROW)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, word, n) rows to counts by part and 5-gram; a task hands them
    on whenever its counter is full."""
    counts: Counter = Counter()

    def handed() -> pa.RecordBatch:
        parts, items = zip(*counts) if counts else ((), ())
        arrays = [pa.array(parts, pa.int32()), pa.array(items, pa.binary()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, schema=_COUNTED_ARROW)

    for batch in batches:
        for part, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for g in grams(word):
                counts[part, g] += n
        if len(counts) > TASK_ENTRIES:
            yield handed()
            counts = Counter()
    yield handed()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, words) rows to the distinct 5-grams of each chunk."""
    for batch in batches:
        for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
            found: set[bytes] = set()
            for word in zstandard.ZstdDecompressor().decompress(data).split():
                found.update(grams(word))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array(sorted(found), pa.binary())], schema=_ASKED_ARROW)


@dataclass
class Model:
    """Texts by 5-gram (``item``) and class (``n0`` and ``n1``), the shared
    backoff by pair of bytes, and the weights of the features."""

    counts: DataFrame
    pairs: np.ndarray
    weights: tuple[float, ...] = ()


def training_rows(packed: Packed, labels: DataFrame) -> DataFrame:
    """(chunk, at, toxic, draw): one labelled row that is not held out for
    each distinct text and label; ``draw`` orders them at random."""
    label = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = packed.rows.where("at >= 0 AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    # Repeated rows are one before the shuffle; labels grow with the corpus, so that it is one at every size.
    once = texts.groupBy("doc_id", "h1", "h2").agg(F.min(F.struct("chunk", "at")).alias("place"))
    return (
        once.join(label.hint("merge"), "doc_id")
        .groupBy("h1", "h2", "toxic")
        .agg(F.min("place").alias("place"))
        .select("place.chunk", "place.at", "toxic", F.xxhash64(F.lit("calibration"), "h1").alias("draw"))
    )


def fit(docs: DataFrame | Packed, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """A model of ``docs`` (``doc_id``, ``text``; or packed ones) by
    ``labels`` (``doc_id``, ``toxic``); None without a row of both classes."""
    if not isinstance(docs, Packed):
        packed = pack(docs.select("doc_id", "text"))
        try:
            return fit(packed, labels, calibration_rows)
        finally:
            packed.release()
    rows = training_rows(docs, labels).cache()
    try:
        found = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first"), F.max("draw").alias("last"))
        classes = {r["toxic"]: r for r in found.collect()}
        if not all(c in classes for c in (0, 1)):
            return None
        share = min(1 / CALIBRATION_FOLD, calibration_rows / sum(r["n"] for r in classes.values()))
        below = -(1 << 63) + int(share * (1 << 64))
        # At least one text of each class to calibrate by, and one to count.
        limit, last, alone = (
            F.when(F.col("toxic") == 0, classes[0][k] if k else classes[0]["n"] == 1).otherwise(classes[1][k] if k else classes[1]["n"] == 1)
            for k in ("first", "last", None)
        )
        chosen = (F.col("draw") <= F.greatest(limit, F.lit(below))) & ((F.col("draw") < last) | alone)
        dealt = rows.withColumn("chosen", chosen).withColumn("part", F.when(chosen & ~alone, F.col("toxic") + 2).otherwise(F.col("toxic")))
        bags = docs.rows.select("chunk", "at", "data").groupBy("chunk")
        counts = _counts(bags.cogroup(dealt.select("chunk", "at", "part").groupBy("chunk")).applyInArrow(_counted_chunk, _COUNTED))
        sample = bags.cogroup(dealt.where("chosen").select("chunk", "at", "toxic").groupBy("chunk")).applyInArrow(_sampled_chunk, "toxic int, text string")
        unseen = Model(counts.select("item", "n0", "n1").where("n0 + n1 > 0"), _backoff(counts.where("n0 + n1 > 0")))
        # Its labels go where other texts have their ids.
        sample = pack(sample.select(F.col("toxic").alias("doc_id"), "text").repartition(SAMPLE_PARTS))
        points = _features(sample, unseen).select("doc_id", "f").collect()
        sample.release()
        weights = _logistic(np.array([r["f"] for r in points]), np.array([r["doc_id"] for r in points], float))
        every = counts.select("item", (F.col("n0") + F.col("c0")).alias("n0"), (F.col("n1") + F.col("c1")).alias("n1"))
        return Model(every, _backoff(counts), weights)
    finally:
        rows.unpersist()


def _counts(words: DataFrame) -> DataFrame:
    """Counts by 5-gram of (part, word, n) rows: ``n0`` and ``n1`` of parts
    0 and 1, ``c0`` and ``c1`` of parts 2 and 3."""
    spark = words.sparkSession
    once = words.groupBy("part", "item").agg(F.sum("n").alias("n"))
    by_part = [F.sum(F.when(F.col("part") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(("n0", "n1", "c0", "c1"))]
    path = shared_dir(spark, f"grams-{uuid.uuid4().hex}")
    once.mapInArrow(_grams, _COUNTED).groupBy("item").agg(*by_part).write.parquet(path)
    return spark.read.schema("item binary, n0 long, n1 long, c0 long, c1 long").parquet(path)


def _backoff(counts: DataFrame) -> np.ndarray:
    """The shared probability of a byte after one other, by both."""
    # Continuation counts of both classes: how many bytes stand before a pair.
    third = counts.select(F.substring("item", ORDER - SHARED, SHARED + 1).alias("t")).distinct()
    continued = third.groupBy(F.substring("t", 2, SHARED).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    pairs, pair_rest, single = _shared({bytes(r["p"]): r["n"] for r in continued})
    out = np.empty((256, 256))
    for a in range(256):
        for b in range(256):
            h, x = bytes([a]), bytes([b])
            p = single.get(x, 0.0) + single[b""] / 256
            out[a, b] = pairs.get(h + x, 0.0) + pair_rest.get(h, 1.0) * p
    return out


def _shared(continued: dict[bytes, int]) -> tuple[dict, dict, dict]:
    """The shared backoff from continuation counts of byte pairs."""
    after, kinds, before = Counter(), Counter(), Counter()
    for pair, n in continued.items():
        after[pair[:1]] += n
        kinds[pair[:1]] += 1
        before[pair[1:]] += 1
    pairs = {p: (n - DISCOUNT) / after[p[:1]] for p, n in continued.items()}
    pair_rest = {h: DISCOUNT * kinds[h] / after[h] for h in after}
    total = max(sum(before.values()), 1)
    single = {x: (n - DISCOUNT) / total for x, n in before.items()}
    single[b""] = DISCOUNT * len(before) / total if before else 1.0
    return pairs, pair_rest, single


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Bias and weights of a logistic regression, by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    weights = b[1:] / spread
    return (float(b[0] - weights @ mean), *map(float, weights))


def _discounted(counts: dict[bytes, int]) -> dict[bytes, list]:
    """By context: the sum of its counts, and how many there are."""
    out: dict[bytes, list] = {}
    for g, n in counts.items():
        entry = out.setdefault(g[:-1], [0, 0])
        entry[0] += n
        entry[1] += 1
    return out


def _continued(counts: dict[bytes, int]) -> dict[bytes, int]:
    """Continuation counts of the next lower order; n-grams that begin at
    the word's begin have one continuation only and keep their counts."""
    out: Counter = Counter()
    for g, n in counts.items():
        out[g[1:]] += n if g[1:2] == _BEGIN else 1
    return out


def _pair_ratios(known: pa.Table, asked: pa.Table, pairs: np.ndarray) -> pa.Table:
    """Ratios of the 5-grams asked for, from all known ones with the same
    two bytes before the last."""
    wanted = asked["g"].to_pylist()
    if not wanted:
        return _RATIOS_ARROW.empty_table()
    items = known["item"].to_pylist()
    by_class = []
    for c in ("n0", "n1"):
        orders = [{g: n for g, n in zip(items, known[c].to_pylist()) if n}]
        while len(orders) < ORDER - SHARED:
            orders.append(_continued(orders[-1]))
        by_class.append([(counts, _discounted(counts)) for counts in reversed(orders)])
    ratios = []
    for g in wanted:
        p = [pairs[g[-2], g[-1]]] * 2
        for c, orders in enumerate(by_class):
            for order, (counts, contexts) in enumerate(orders, SHARED + 1):
                suffix = g[ORDER - order :]
                total = contexts.get(suffix[:-1])
                if total:
                    p[c] = (max(counts.get(suffix, 0) - DISCOUNT, 0.0) + DISCOUNT * total[1] * p[c]) / total[0]
        ratios.append(math.log(p[1] / p[0]))
    return pa.Table.from_arrays([pa.array(wanted, pa.binary()), pa.array(ratios, pa.float64())], schema=_RATIOS_ARROW)


def gram_ratios(asked: DataFrame, model: Model) -> DataFrame:
    """(g, ratio) for each distinct 5-gram ``g`` of ``asked``: log p(last
    byte | the others, toxic) - log p(... | ordinary)."""
    # All that a 5-gram's orders 3 to 5 need has the same two bytes before the last.
    at, pairs = ORDER - SHARED, model.pairs
    known = model.counts.select(F.substring("item", at, SHARED).alias("pair"), "item", "n0", "n1")
    wanted = asked.select("g").distinct().select(F.substring("g", at, SHARED).alias("pair"), "g")
    return known.groupBy("pair").cogroup(wanted.groupBy("pair")).applyInArrow(lambda k, w: _pair_ratios(k, w, pairs), "g binary, ratio double")


def _features(packed: Packed, model: Model) -> DataFrame:
    """(doc_id, h1, h2, f) for each text: its features."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*packed.rows.select("doc_id", "h1", "h2").schema.fields, T.StructField("f", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)
    asked = packed.rows.where("at = -1").select("chunk", "data").mapInArrow(_asked, _ASKED).repartition("g")
    found = asked.join(gram_ratios(asked, model).hint("shuffle_merge"), "g").select("chunk", "g", "ratio")

    def add(chunk: pa.Table, ratios: pa.Table) -> pa.Table:
        by_gram = dict(zip(ratios["g"].to_pylist(), ratios["ratio"].to_pylist()))
        words, bags, order = _opened(chunk)
        evidence = np.array([min(max(math.fsum([by_gram[g] for g in grams(w)]), -CLIP), CLIP) for w in words])
        made = []
        for bag in bags:
            # Exact sums: equal texts of different chunks have their words in another order.
            own, n = evidence[bag] if len(bag) else np.empty(0), max(len(bag), 1)
            made.append([math.fsum(own.tolist()) / n, math.fsum(own[own > DECISIVE].tolist()) / n, math.log(n)])
        rows = chunk.select(["doc_id", "h1", "h2"]).take(pa.array(order))
        return pa.Table.from_arrays([*rows.columns, pa.array(made, schema.field("f").type)], schema=schema)

    bags = packed.rows.select("chunk", "at", "doc_id", "h1", "h2", "data")
    return bags.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(add, out)


def scores(packed: Packed, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h1, h2, score, predicted) for each packed text."""
    if model is None:
        made = packed.rows.where("at >= 0").select("doc_id", "h1", "h2", F.lit(0.0).alias("score"))
    else:
        bias, *weights = model.weights
        logit = F.lit(bias)
        for i, w in enumerate(weights):
            logit += F.lit(w) * F.col("f")[i]
        sure = F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))
        made = _features(packed, model).select("doc_id", "h1", "h2", (1 / (1 + F.exp(-sure))).alias("score"))
    spark = made.sparkSession
    path = shared_dir(spark, f"scores-{uuid.uuid4().hex}")
    made.write.parquet(path)
    done = spark.read.schema(made.schema).parquet(path)
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, packed: Packed | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is
    at least ``threshold``). Input columns of these names are replaced.
    ``packed`` holds the same texts, if they have been packed already."""
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    if model is None:
        return base.withColumns({"score": F.lit(0.0), "predicted": (F.lit(0.0) >= threshold).cast("int")})
    own = packed or pack(base.select("text"))
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, f"scored-{uuid.uuid4().hex}")
    scores(own, model, threshold).groupBy("h1", "h2").agg(F.max("score").alias("score")).write.parquet(path)
    if packed is None:
        own.release()
    # Names that no column of the documents has. The written side lets Spark split a hot text of the other.
    names = [f"{h}_{uuid.uuid4().hex}" for h in ("h1", "h2")]
    by_text = spark.read.schema("h1 long, h2 long, score double").parquet(path).toDF(*names, "score")
    joined = base.withColumns(dict(zip(names, _text_keys()))).join(by_text.hint("merge"), names, "left")
    return joined.drop(*names).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
