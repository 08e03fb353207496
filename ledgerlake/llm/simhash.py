"""SimHash near duplicates by meet-in-the-middle ball hashing.

The fingerprint of a text: A-Z lower-cased, words between ASCII whitespace,
every shingle of ``shingle`` words (repeats too, joined by a space; fewer
words make one shingle), XXH64 with seed 42 of each; a bit is 1 if more
than half of the hashes have it. No words: fingerprint 0. Fingerprints that
differ in at most ``distance`` = 3 bits are linked.

Linking works on distinct fingerprints. Two at distance d <= 3 meet at a
variant that is within 2 bits of one and 1 bit of the other. If d is odd
their bit counts differ in parity, so it is enough that only even ones emit
radius 2; and of any three bits two lie in the same half of the 64, so
radius-2 variants need only flip two bits of one half:

* odd fingerprints emit themselves and their 64 one-bit variants,
* even ones these too, and 992 two-bit variants.

A variant is a group of at most a few hundred distinct fingerprints (a ball
has no more), so no group can be hot. All that reach it by at most one bit
are within 2 bits of each other, and those that reach it by two within 3 of
each of the first; so one star around the smallest of the first says
everything, and no pairs within a group are made. Each star edge is
verified by its bit distance. Where none reaches a variant by at most one
bit, the group proves no link.

Variants travel sorted, as compressed gaps with two bytes for the flip that
leads back to the fingerprint, cut into buckets by a hash of the variant. A bucket reduces
its edges to a forest before they leave it. The components of what is left
are found by alternating large-star and small-star steps, each written to
the checkpoint folder; an equal-fingerprint group of any size is one node.

Defined results: null and empty texts have fingerprint 0 and link like any
other; a component's id is its smallest non-null ``doc_id`` (null if it has
none); rows with the same ``doc_id`` are texts of their own; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import (
    bounded_arrow,
    groups_of,
    mix,
    pack_sorted,
    parts_by_size,
    small_batches,
    unpack_sorted,
)
from ledgerlake.session import ensure_checkpoint_dir

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Variants that a bucket holds, about.
BUCKET_VARIANTS = 3_000_000
#: Fingerprints whose variants a task makes at once.
BLOCK = 2_000

_ONE = [1 << b for b in range(64)]
_TWO = [1 << a | 1 << b for half in (0, 32) for a in range(half, half + 32) for b in range(a + 1, half + 32)]
#: Flips by index: none, one bit, two bits of one half.
FLIPS = np.array([0, *_ONE, *_TWO], np.uint64)
_NEAR = 1 + len(_ONE)

_SENT = "bucket int, data binary, flips binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("flips", pa.binary())])
_EDGES = "a long, b long"
_EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 65_536):
        ones += np.unpackbits(every[i : i + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, column: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a (signed) long."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_arrow(docs.sparkSession)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != column])
    out = T.StructType([*base.schema.fields, T.StructField(column, T.LongType())])
    schema, at = to_arrow_schema(out), base.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole):
                values = np.array([simhash(t, shingle) for t in batch.column(at).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], schema=schema)

    return base.mapInArrow(add, out)


def hex_fingerprint(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _variants(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted variants of blocks of fingerprints, by bucket."""
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(every), BLOCK):
            block = every[i : i + BLOCK]
            even = np.bitwise_count(block) % 2 == 0
            made = [(block[even], len(FLIPS)), (block[~even], _NEAR)]
            values = np.concatenate([(fps[:, None] ^ FLIPS[None, :n]).ravel() for fps, n in made])
            flips = np.concatenate([np.tile(np.arange(n, dtype="<u2"), len(fps)) for fps, n in made])
            # By the mixed value: near copies share high bits, so ranges of the raw one crowd.
            bucket = mix(values) % np.uint64(buckets)
            order = np.lexsort((values, bucket))
            values, flips = values[order], flips[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, pack_sorted(values[s:e]), flips[s:e].tobytes()) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT_ARROW)], schema=_SENT_ARROW)


def _stars(table: pa.Table, distance: int) -> pa.Table:
    """The verified star edges of a bucket's variants, as a forest."""
    values = np.concatenate([unpack_sorted(d) for d in table.column("data").to_pylist()])
    flips = np.concatenate([np.frombuffer(d, "<u2") for d in table.column("flips").to_pylist()])
    order = np.argsort(values, kind="stable")
    values, flips = values[order], flips[order]
    first = groups_of(values)
    size = np.diff(np.append(first, len(values)))
    shared = np.repeat(size > 1, size)
    values, flips = values[shared], flips[shared]
    first = groups_of(values)
    if not len(first):
        return _EDGES_ARROW.empty_table()
    fps = values ^ FLIPS[flips]
    size = np.diff(np.append(first, len(values)))
    # The hub: the smallest that reaches the variant by at most one bit.
    hub = np.repeat(np.minimum.reduceat(np.where(flips < _NEAR, fps, np.uint64(0xFFFFFFFFFFFFFFFF)), first), size)
    linked = (fps != hub) & (np.bitwise_count(fps ^ hub) <= distance)
    near = np.repeat(np.bitwise_or.reduceat((flips < _NEAR).astype(np.uint8), first), size) > 0
    edges = np.unique(np.stack([fps, hub], 1)[linked & near], axis=0)
    return _forest(edges)


def _forest(edges: np.ndarray) -> pa.Table:
    """The same components with fewer edges: each node to its root."""
    nodes, index = np.unique(edges, return_inverse=True)
    index = index.reshape(-1, 2)
    root = list(range(len(nodes)))
    for a, b in index.tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    roots = nodes[np.asarray(root, np.int64)]
    moved = roots != nodes
    return pa.Table.from_arrays([pa.array(nodes[moved].view(np.int64)), pa.array(roots[moved].view(np.int64))], schema=_EDGES_ARROW)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between the values of ``distinct.fingerprint`` whose
    components are those of all links of at most ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("variants of half the radius are built for a distance of at most 3")
    # Half of all fingerprints emit about a thousand variants.
    buckets, _ = parts_by_size(distinct, F.lit(len(FLIPS) // 2), BUCKET_VARIANTS)
    sent = distinct.select("fingerprint").mapInArrow(lambda it: _variants(it, buckets), _SENT)
    return sent.groupBy("bucket").applyInArrow(lambda t: _stars(t, distance), _EDGES)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node of its component. Large-star and small-star steps in turn until
    nothing changes; every step is checkpointed to the shared folder."""
    ensure_checkpoint_dir(edges.sparkSession)
    cur = _oriented(edges).checkpoint()
    count = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        cur = _small_star(_large_star(cur)).checkpoint()
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == count:
            break
        count = now
    roots = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    # Checkpointed, so that Spark can split the join at a node with very many neighbours.
    smallest = smallest.select("node", F.least("node", "m").alias("m")).checkpoint()
    larger = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    # ``edges`` runs from larger to smaller: a node's larger neighbours are its a's.
    return _oriented(larger.join(smallest, "node").select(F.col("other").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(smallest.select("a", F.col("m").alias("b"))))


def _components(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fingerprint), and by fingerprint the first
    (null last, doc_id, text_hash) of its component."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select("doc_id", "text", _text_hash().alias("text_hash"))
    ids = fingerprints(texts, shingle).select("doc_id", "text_hash", "fingerprint").checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    members = ids.groupBy("fingerprint").agg(F.min(order).alias("first")).checkpoint()
    roots = connected(links(members, distance))
    # Checkpoints leave plain exchanges to the joins on keys that can be hot.
    labelled = (
        members.join(roots, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
        .checkpoint()
    )
    smallest = labelled.groupBy("root").agg(F.min("first").alias("keeper")).checkpoint()
    named = labelled.join(smallest, "root").select("fingerprint", "keeper").checkpoint()
    return ids, named


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id`` for each row
    of ``docs`` (``doc_id``, ``text``)."""
    ids, named = _components(docs, shingle, distance)
    return ids.join(named, "fingerprint").select("doc_id", "fingerprint", F.col("keeper.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``doc_id``,
    nulls last, and of several texts under that id the one with the
    smallest hash. Of rows with equal id and text one stays."""
    ids, named = _components(docs, shingle, distance)
    copies = ids.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.first("fingerprint").alias("fingerprint"))
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    keepers = (
        copies.join(named, "fingerprint")
        .where(own.eqNullSafe(F.col("keeper")))
        .select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "n")
        .checkpoint()
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("r_id"),
        _text_hash().alias("r_hash"),
    )
    kept = rows.join(keepers, F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_hash") == F.col("k_hash")))
    # Only rows that are repeated as they stand need another look.
    single = kept.where("n = 1").select("row")
    several = kept.where("n > 1").groupBy("r_id", "r_hash").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(several).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
