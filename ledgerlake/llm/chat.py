"""Chat formatting with rotated perspectives.

For every participant of a conversation the dialogue is rendered once, with
that participant as the assistant and the others as users with their names;
system turns stay system turns. The mask holds the spans (code points of
the rendered text, end exclusive) that the model is to learn: the
assistant's words with the end mark.

A conversation is rendered in parts of ``part_turns`` turn numbers, so a
very long one is many rows instead of one that no task could hold; the
parts' texts in order of ``part`` are the whole rendering, and each part's
mask counts from the part's own start. Participants meet parts in a join
on the conversation, which Spark splits when one conversation is hot.

Defined results: a null or empty name is the participant "unknown"; a null
text is empty; a null turn comes first, as part -1; turns with the same
number are ordered by name and text, and repeated rows stay repeated; a
conversation with only system turns has no perspective and gives no row; a
null ``conv_id`` is a conversation of its own; marks inside a text are
broken up with a space so that they can't end a turn; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import ensure_checkpoint_dir

PART_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def _head(name: Column, perspective: Column) -> Column:
    role = (
        F.when(name == perspective, F.lit("assistant"))
        .when(name == SYSTEM, F.lit(SYSTEM))
        .otherwise(F.concat(F.lit("user name="), name))
    )
    return F.concat(F.lit(START), role, F.lit("\n"))


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def rotate_perspectives(
    conversations: DataFrame, speaker: str = "role", part_turns: int = PART_TURNS
) -> DataFrame:
    """One row for each conversation, perspective and part: ``conv_id``,
    ``perspective``, ``part``, ``n_turns``, ``rendered`` and ``mask``
    (array of (start, end)). Needs ``conv_id``, ``turn``, ``text`` and the
    column ``speaker``."""
    ensure_checkpoint_dir(conversations.sparkSession)
    name = F.translate(F.coalesce(F.col(f"`{speaker}`"), F.lit("")), "\n\r", "  ")
    said = conversations.select(
        "conv_id", "turn", F.when(name == "", F.lit(UNKNOWN)).otherwise(_safe(name)).alias("name"), _safe(F.col("text")).alias("said")
    )
    parts = said.groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "name", "said"))).alias("turns")
    )
    # The participants are checkpointed to leave two plain exchanges to the join.
    speakers = said.where(F.col("name") != SYSTEM).select("conv_id", F.col("name").alias("perspective")).distinct().checkpoint()
    both = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))

    def step(acc: Column, t: Column) -> Column:
        head = _head(t["name"], F.col("perspective"))
        body = F.concat(t["said"], F.lit(END))
        start = acc["at"] + F.char_length(head)
        end = start + F.char_length(body)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(t["name"] == F.col("perspective"), F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"),
        )

    rendered = F.array_join(
        F.transform("turns", lambda t: F.concat(_head(t["name"], F.col("perspective")), t["said"], F.lit(END + "\n"))), ""
    )
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    mask = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("mask")), step)["mask"]
    return both.select(
        F.col("p.conv_id").alias("conv_id"),
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        rendered.alias("rendered"),
        mask.alias("mask"),
    )
