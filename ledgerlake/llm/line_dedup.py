"""Line deduplication: lines that repeat across documents stay in one only.

Every text is split at newlines. A line's key is the line without ASCII
whitespace at both ends and with A-Z in lower case. The distinct keys of a
document are exploded as two independent 64-bit hashes, and one aggregate
(with a map-side partial one, so a line that stands in a third of all
documents costs each task one row) finds the keys held by ``min_documents``
or more distinct documents together with the smallest holding ``doc_id``.
All other holders lose those lines; the rest is put together again in
order, in place, with higher-order functions on the line array.

Plan: the key table and the dropped keys of each id are checkpointed, so
that both sides of their joins are plain exchanges and Spark splits a hot key
(many rows of one id or of none included). Texts are shuffled once, by
``doc_id``, to meet their dropped keys, a sorted array searched by halving.

Defined results: a null text is one empty line; a null ``doc_id`` neither
holds a key nor loses a line; rows with the same ``doc_id`` count as one
document and each is cleaned on its own; keys shorter than ``min_chars``
code points are never dropped; an empty table gives an empty result; other
input columns, whatever their names, are passed through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import WHITESPACE, lower_ascii, text_or_empty
from ledgerlake.session import ensure_checkpoint_dir

MIN_CHARS = 10
MIN_DOCUMENTS = 2


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITESPACE)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _among(value: Column, ordered: Column) -> Column:
    """Whether ``value`` is in an ascending array, by halving steps: linear
    search would take the square of a long text's dropped lines."""

    def search(v: Column) -> Column:
        bits = F.ceil(F.log2(F.size(ordered) + 1)).cast("int")
        steps = F.sequence(bits, F.lit(0), F.lit(-1))

        def step(at: Column, bit: Column) -> Column:
            further = at + F.call_function("shiftleft", F.lit(1), bit)
            return F.when(F.get(ordered, further) <= v, further).otherwise(at)

        last = F.aggregate(steps, F.lit(-1), step)
        return F.coalesce(F.get(ordered, last) == v, F.lit(False))

    return F.transform(F.array(value), search)[0]


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``docs`` (needs ``doc_id`` and ``text``) with repeated lines removed
    from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    Input columns called ``n_lines`` or ``n_dropped`` are replaced.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    doc = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("body"))
    keys = F.transform(_lines(F.col("body")), _key)
    # Distinct as strings, which Spark hashes; structs it would compare in pairs.
    long_keys = F.transform(F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars)), _hashes)
    held = (
        doc.where(F.col("id").isNotNull())
        .select("id", F.explode(long_keys).alias("k"))
        .select("id", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    )
    per_key = held.groupBy("h1", "h2")
    if min_documents == 2:  # two distinct holders are there if the smallest and the largest differ
        spread = per_key.agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        spread = (
            held.distinct().groupBy("h1", "h2")
            .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_documents)
        )
    repeated = spread.select("h1", "h2", "first").checkpoint()
    drops = (
        held.join(repeated, ["h1", "h2"])
        .where(F.col("id") > F.col("first"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("drop"))
        .checkpoint()
    )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("id", F.col("row.doc_id"))
    lines = _lines(F.coalesce(F.col("row.text"), F.lit("")))

    def stays(line: Column) -> Column:
        key = _key(line)
        return F.when(F.char_length(key) < min_chars, True).otherwise(~_among(_hashes(key), F.col("drop")))

    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, stays))
    out = rows.join(drops, "id", "left").select("row", lines.alias("before"), kept.alias("after"))
    return out.select(
        *[
            F.array_join("after", "\n").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ],
        F.size("before").cast("long").alias("n_lines"),
        (F.size("before") - F.size("after")).cast("long").alias("n_dropped"),
    )
