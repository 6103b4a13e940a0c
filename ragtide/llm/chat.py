"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often store a conversation again after every turn.  Each conversation's turns
get two 64-bit rolling prefix hashes (a running XOR of hashes keyed by position, role and
text); the last one names the whole conversation.  A conversation whose name is a strict
prefix hash of another is a snapshot of it.  Equal conversations collapse onto the
smallest conv_id first (partial aggregation), an anti-join then keeps the maximal ones,
and only their turns are rendered.

Defined results: turns are taken in the order (turn, role, text), nulls first, so ties and
repeated rows have one order; a null role or text renders as empty and differs from an
empty one in the hashes; rows with a null conv_id form no conversation and are left out;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Every turn with its place and the hashes (p1, p2) of its conversation up to it."""
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = [F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    placed = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(ordered))
    for k in (1, 2):
        placed = placed.withColumn(f"p{k}", F.bit_xor(F.xxhash64(F.lit(k), "place", *content)).over(running))
    return placed


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no longer one begins with."""
    names = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("place", "p1", "p2"), "place").alias("end")).select("conv_id", "end.*")
    # copies become one row before anything is joined: a common conversation is no hot key
    whole = names.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    last = Window.partitionBy("conv_id")
    strict = (prefixes.withColumn("n", F.count("*").over(last)).where("place < n")
              .select("place", "p1", "p2").distinct())
    kept = whole.join(strict, ["place", "p1", "p2"], "left_anti")
    return kept.select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """One ``text`` per conversation: each turn between role marks, in order."""
    part = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = turns.select("conv_id", F.struct("place", part.alias("part")).alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["part"]), "")
    return rows.groupBy("conv_id").agg(joined.alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as chat text: conv_id, n_turns, n_copies, text."""
    prefixes = prefix_hashes(conversations)
    kept = maximal(prefixes)
    turns = prefixes.join(kept.select("conv_id"), "conv_id", "left_semi")
    return kept.join(render(turns), "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "text")
