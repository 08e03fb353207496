"""Prefix trie of conversations by van Emde Boas recursion.

A node is a distinct sequence of first turns. To build the trie, sequences
are cut at half of their depth (the largest power of two that fits): the
part above the cut is named by a hash of the name it hangs on and of its
turns, equal cut prefixes become one, and two smaller problems remain, the
upper trie of the cut prefixes and the forest of what hangs below them. All
problems of one size are solved together, in parallel, so a corpus whose
longest conversation has n turns takes log2(n) steps, and a conversation
takes part only in the log2 of its own length. A cut prefix keeps how many
conversations it stands for and their smallest id; one copy of its turns
goes on.

Totals are grafted upward in the same cuts, smallest first: once the parts
of up to 2^j turns are done, the totals below a node at an odd multiple of
2^j are added to it and to its ancestors down from the next cut above it.
These chains of ancestors double from step to step.

Every step is written as a table under ``spark.checkpoint.dir``. Only turn
hashes and lengths travel, no texts. Keys that can be hot (a prefix that a
third of all conversations share, one endless conversation, one node where
thousands end) meet in aggregates with a partial phase, in joins whose
sides Spark can split, or in ranges. Prefix names are 128-bit hashes.

Defined results: a null role or text is empty; a null turn number comes
first; turns with one number are ordered by role, then text, and repeated
rows are turns of their own; rows without a ``conv_id`` belong to no
conversation and are left out; a negative id has the remainder that SQL
gives it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import shuffle_partitions
from ledgerlake.operators.ordinal import number_rows
from ledgerlake.session import ensure_checkpoint_dir, shared_dir

SPAN = 100
HEADS = 6
#: Conversation ids in one piece of a node's list.
PIECE = 4096

_ROWS = (
    "ra long, rb long, seq long, pos long, sa long, sb long, na long, nb long, chars long, w long, rep long, m long, open boolean, "
    "step int, level int"
)
_CUTS = "ra long, rb long, seq long, ca long, cb long, w long, rep long, m long, open boolean, step int"
_PARTS = "na long, nb long, ra long, rb long, depth long, leaves long, saved long, step int"
_PIECES = "na long, nb long, first long, ids string"
_DIGESTS = "na long, nb long, ends_sha256 string"
#: The name of the textless root.
ROOT = (0, 0)


def _names(*values: Column | str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (the turns of all conversations numbered in order:
    those of one follow each other), ``sa``, ``sb`` (hash of role and text)
    and ``chars`` (code points of the text). Runs jobs."""
    ensure_checkpoint_dir(conversations.sparkSession)
    said = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    sa, sb = _names("role", "text")
    slim = ["conv_id", "turn", sa.alias("sa"), sb.alias("sb"), F.char_length("text").cast("long").alias("chars")]
    every = said.select(*slim, F.lit(0).cast("long").alias("tie"))
    # Only turns that share a number need their texts to be ordered.
    shared = said.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")).checkpoint()
    if not shared.isEmpty():
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        tied = number_rows(said.join(shared, same, "left_semi"), ["conv_id", "turn"], [F.col("role"), F.col("text")], "tie")
        every = every.join(shared, same, "left_anti").unionByName(tied.select(*slim, "tie"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie")]
    return number_rows(every, [], order, "at").select("conv_id", "at", "sa", "sb", "chars")


def share_heads(turns: DataFrame, span: int = SPAN, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike: each takes the first h turns of the
    one at the start of its ``span``, then its own after the first h, with
    h = crc32 of its decimal id modulo ``heads``. Returns (turns, lengths):
    ``conv_id, pos, total, sa, sb, chars`` and ``conv_id, total``."""
    own = turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("held"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    total = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    # Checkpointed, so that Spark can split the join at an endless conversation.
    convs = convs.withColumn("total", total).drop("own", "held").checkpoint()
    placed = turns.join(convs, "conv_id").withColumn("n", F.col("at") - F.col("first"))
    rest = placed.where("n >= h").select("conv_id", (F.col("taken") + F.col("n") - F.col("h")).alias("pos"), "total", "sa", "sb", "chars")
    lent = placed.where((F.col("n") < heads - 1) & (F.col("conv_id") % span == 0)).select(F.col("conv_id").alias("base"), "n", "sa", "sb", "chars")
    taken = convs.join(lent, "base").where("n < h").select("conv_id", F.col("n").alias("pos"), "total", "sa", "sb", "chars")
    return taken.unionByName(rest), convs.select("conv_id", "total")


def _level(m: Column) -> Column:
    """The step at which a sequence with ``m`` unnamed turns is cut."""
    return F.when(m > 0, F.length(F.bin(m))).otherwise(F.lit(0)).cast("int")


def _name_prefixes(turns: DataFrame, top: int, base: str) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): every turn of a distinct sequence with the name of its
    prefix and of the prefix before it, and the name at which each
    conversation ends. ``top`` is the level of the longest one.

    ``m`` counts the turns of a sequence that have no name yet: all, or all
    but the last, where the sequence is itself a cut prefix (not ``open``).
    """
    spark = turns.sparkSession
    start = turns.select(
        *[F.lit(x).cast("long").alias(c) for x, c in zip(ROOT, ("ra", "rb"))],
        F.col("conv_id").alias("seq"), "pos", "sa", "sb",
        *[F.lit(None).cast("long").alias(c) for c in ("na", "nb")],
        "chars", F.lit(1).cast("long").alias("w"), F.col("conv_id").alias("rep"),
        F.col("total").alias("m"), F.lit(True).alias("open"), _level(F.col("total")).alias("level"),
    )
    start.write.partitionBy("level").parquet(f"{base}/rows/step=0")
    for step, k in enumerate(range(top, 0, -1), 1):
        half = 1 << (k - 1)
        now = spark.read.schema(_ROWS).parquet(f"{base}/rows").where(F.col("level") == k).drop("step", "level")
        now = now.withColumn("lower", F.shiftright("pos", k - 1).bitwiseAND(1) == 1)
        xa, xb = _names("pos", "sa", "sb")
        cuts = now.where("NOT lower").groupBy("ra", "rb", "seq").agg(
            F.bit_xor(xa).alias("xa"), F.bit_xor(xb).alias("xb"), F.max("w").alias("w"), F.min("rep").alias("rep"), F.max("m").alias("m"), F.max("open").alias("open")
        )
        ca, cb = _names("ra", "rb", "xa", "xb", F.lit(half))
        cuts.select("ra", "rb", "seq", ca.alias("ca"), cb.alias("cb"), "w", "rep", "m", "open").write.parquet(f"{base}/cuts/step={step}")
        cuts = spark.read.schema(_CUTS).parquet(f"{base}/cuts").where(F.col("step") == step).drop("step")
        # One copy of equal cut prefixes goes on, for all of them.
        groups = cuts.groupBy("ra", "rb", "ca", "cb").agg(F.min("seq").alias("seq"), F.sum("w").alias("gw"), F.min("rep").alias("grep"))
        below = cuts.select("ra", "rb", "seq", "ca", "cb", *[F.lit(None).cast("long").alias(c) for c in ("gw", "grep")], F.lit(True).alias("lower"))
        both = now.join(groups.withColumn("lower", F.lit(False)).unionByName(below), ["ra", "rb", "seq", "lower"])
        last = ~F.col("lower") & ((F.col("pos") + 1) % half == 0)
        m = F.when(F.col("lower"), F.col("m") - half).otherwise(F.lit(half - 1)).cast("long")
        both.select(
            *[F.when(F.col("lower"), F.col(c)).otherwise(F.col(r)).alias(r) for r, c in (("ra", "ca"), ("rb", "cb"))],
            "seq", "pos", "sa", "sb",
            *[F.when(last, F.col(c)).otherwise(F.col(n)).alias(n) for n, c in (("na", "ca"), ("nb", "cb"))],
            "chars", F.coalesce("gw", "w").alias("w"), F.coalesce("grep", "rep").alias("rep"), m.alias("m"), (F.col("open") & F.col("lower")).alias("open"), _level(m).alias("level"),
        ).write.partitionBy("level").parquet(f"{base}/rows/step={step}")
    rows = spark.read.schema(_ROWS).parquet(f"{base}/rows").where("level = 0 AND na IS NOT NULL")
    if not top:
        return rows, spark.createDataFrame([], "conv_id long, na long, nb long")
    ended = spark.read.schema(_CUTS).parquet(f"{base}/cuts").where(F.col("open") & (F.col("m") == F.expr(f"shiftleft(1L, {top} - step)")))
    return rows, ended.select(F.col("seq").alias("conv_id"), F.col("ca").alias("na"), F.col("cb").alias("nb"))


def _graft(nodes: DataFrame, deepest: int, base: str) -> DataFrame:
    """Parts (one or more rows a node) that sum up to the totals of each
    node's subtree. ``nodes`` has ``n_children`` and is a written table."""
    spark = nodes.sparkSession
    own = nodes.where("depth > 0").select("na", "nb", "ra", "rb", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own.write.parquet(f"{base}/parts/step=0")
    # Chains: from a node ``e`` (at depth ``at``) to its ancestors, itself too,
    # above which no cut of the step lies.
    chains = nodes.where("depth > 0").select(F.col("na").alias("ea"), F.col("nb").alias("eb"), F.col("depth").alias("at"), "na", "nb", "ra", "rb", "depth")
    j = 0
    while 1 << j < deepest:
        size = 1 << j
        parts = spark.read.schema(_PARTS).parquet(f"{base}/parts")
        below = parts.where((F.col("depth") - 1) % (2 * size) == size).groupBy(F.col("ra").alias("ea"), F.col("rb").alias("eb")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        grown = chains.where(F.col("at") % (2 * size) == size).join(below, ["ea", "eb"])
        grown.select("na", "nb", "ra", "rb", "depth", "leaves", "saved").write.parquet(f"{base}/parts/step={j + 1}")
        j += 1
        if 1 << j < deepest:
            even = chains.where(F.col("at") % (2 * size) == 0)
            # A chain goes on above its top, at the end of another chain.
            tops = even.where(F.col("depth") == F.col("at") - size + 1).select("ea", "eb", "at", F.col("ra").alias("ma"), F.col("rb").alias("mb"))
            upper = chains.select(F.col("ea").alias("ma"), F.col("eb").alias("mb"), "na", "nb", "ra", "rb", "depth")
            even.unionByName(tops.join(upper, ["ma", "mb"]).drop("ma", "mb")).write.parquet(f"{base}/chains-{j}")
            chains = spark.read.parquet(f"{base}/chains-{j}")
    return spark.read.schema(_PARTS).parquet(f"{base}/parts").drop("step")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, in order, as comma-joined text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        bounds = [*np.flatnonzero(new).tolist(), len(a)]
        rows = [(int(a[s]), int(b[s]), int(ids[i]), ",".join(map(str, ids[i : min(i + PIECE, e)].tolist()))) for s, e in zip(bounds, bounds[1:]) for i in range(s, e, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["na", "nb", "first", "ids"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order."""
    node, digest = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (a, b) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["na", "nb", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["na", "nb", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``na``, ``nb`` and the SHA-256 of the ids (``conv_id``) that end at
    the node, ascending and joined by commas. A node's ids are ranged over
    several tasks, which join them into pieces; one task hashes a node's
    pieces as they stream by."""
    n = shuffle_partitions(ends)
    ranged = ends.select("na", "nb", "conv_id").repartitionByRange(n, "na", "nb", "conv_id").sortWithinPartitions("na", "nb", "conv_id")
    pieces = ranged.mapInArrow(_pieces, _PIECES)
    return pieces.repartition(n, "na", "nb").sortWithinPartitions("na", "nb", "first").mapInArrow(_hash_pieces, _DIGESTS)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node: ``node`` and ``parent`` (names in hex; the
    root's parent is null), ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. ``turns`` has ``conv_id``, ``pos``
    (0, 1, ... without gaps), ``total`` (turns of its conversation), ``sa``,
    ``sb`` (hash of the turn) and ``chars``; ``lengths`` has ``conv_id`` and
    ``total`` of every conversation. Runs jobs."""
    spark = turns.sparkSession
    base = shared_dir(spark, f"trie-{uuid.uuid4().hex}")
    deepest, members, first = lengths.agg(F.coalesce(F.max("total"), F.lit(0)), F.count(F.lit(1)), F.min("conv_id")).first()
    rows, ends = _name_prefixes(turns, deepest.bit_length(), base)
    found = rows.groupBy("na", "nb").agg(
        F.min("ra").alias("ra"), F.min("rb").alias("rb"), (F.max("pos") + 1).alias("depth"),
        F.sum("w").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("chars").alias("chars"),
    )
    found.write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    root = spark.createDataFrame([(*ROOT, 0, members, first, 0)] if members else [], "na long, nb long, depth long, n_convs long, conv_id long, chars long")
    kids = found.select(F.col("ra").alias("na"), F.col("rb").alias("nb"), F.lit(1).cast("long").alias("n_children"))
    facts = ["ra", "rb", "depth", "n_convs", "conv_id", "chars"]
    known = found.unionByName(root, allowMissingColumns=True).unionByName(kids, allowMissingColumns=True).groupBy("na", "nb")
    known.agg(*[F.max(c).alias(c) for c in facts], F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children")).write.parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")
    parts = _graft(nodes, deepest, base).select("na", "nb", "leaves", "saved", "depth")
    whole = parts.where("depth = 1").select(*[F.lit(x).cast("long").alias(c) for x, c in zip(ROOT, ("na", "nb"))], "leaves", "saved")
    short = lengths.where("total = 0").select("conv_id", *[F.lit(x).cast("long").alias(c) for x, c in zip(ROOT, ("na", "nb"))])
    every = nodes.drop("chars")
    for more in (parts.drop("depth"), whole, end_digests(ends.unionByName(short))):
        every = every.unionByName(more, allowMissingColumns=True)
    facts = ["ra", "rb", "depth", "n_convs", "conv_id", "n_children", "ends_sha256"]
    every = every.groupBy("na", "nb").agg(*[F.max(c).alias(c) for c in facts], F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = nodes.select(F.col("na").alias("ra"), F.col("nb").alias("rb"), F.col("conv_id").alias("parent_conv_id"))
    hexed = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    return every.where("depth IS NOT NULL").join(parents, ["ra", "rb"], "left").select(
        hexed("na", "nb").alias("node"), hexed("ra", "rb").alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        # A childless root is the only node without parts.
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def shared_prefixes(conversations: DataFrame, span: int = SPAN, heads: int = HEADS) -> DataFrame:
    """The trie of ``conversations`` (``conv_id``, ``turn``, ``role``,
    ``text``) after ``share_heads``."""
    return prefix_trie(*share_heads(ordered_turns(conversations), span, heads))
