"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs that store a conversation again after each turn hold many conversations
that are prefixes of longer ones.  Every turn gets a rolling hash of the
conversation up to it; an anti-join removes each conversation whose whole hash
is the prefix hash of a longer one, and equal conversations keep one.

The rolling hash is a running XOR of hashes salted with the turn's place, so
it can be put together from blocks of turns: a conversation with very many
turns is spread over blocks, and no task has to hold or sort all of it.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import bounded, cut

#: Turn numbers per block.
BLOCK = 1024
#: The block of turns without a number; it sorts first.
NO_NUMBER = -(1 << 62)
ROLES = ("system", "user", "assistant", "tool")


def logged_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns ``conv_id, block, k`` (place in the block), ``role, text``.

    Rows without a conversation id belong to none and are left out.  Null
    roles and texts count as empty; roles are trimmed and lower-cased.  Rows
    that agree in everything are one turn logged twice; turns with the same
    number are ordered by role and text; a null number sorts first.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(NO_NUMBER)).alias("block"), "turn",
        F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = rows.withColumn("th", F.xxhash64("text")).groupBy("conv_id", "block", "turn", "role", "th").agg(F.first("text").alias("text"))
    place = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return same.select("conv_id", "block", "role", "text", F.row_number().over(place).alias("k"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos`` (1, 2, ...), ``h1, h2``: rolling hashes of the first ``pos`` turns, 128 bits."""
    # Windows over a conversation hold one row per block; turns join their own block's row.
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = turns.join(offsets, ["conv_id", "block"]).withColumn("pos", F.col("k") + F.col("before"))
    salted = cut(placed.select("conv_id", "block", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role", "pos").alias("b")), "turn-hashes")
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = salted.select("conv_id", "block", "pos", F.expr("bit_xor(a)").over(inside).alias("a"), F.expr("bit_xor(b)").over(inside).alias("b"))
    whole = salted.groupBy("conv_id", "block").agg(F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"))
    earlier = whole.select("conv_id", "block", *(F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).alias(f"{c}0") for c in "ab"))
    return local.join(earlier, ["conv_id", "block"]).select("conv_id", "pos", F.expr("a ^ a0").alias("h1"), F.expr("b ^ b0").alias("h2"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_equal``: conversations that are no proper prefix of another; of equal ones the smallest id, with their number."""
    last = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = cut(prefixes.join(last, "conv_id"), "prefixes")
    whole = marked.where("pos = n_turns").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    longer = marked.where("pos < n_turns").select("pos", "h1", "h2").distinct()  # one row per prefix, however many share it
    return whole.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_equal")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Collapse snapshots and render what remains.

    Returns ``conv_id, segment, n_turns, n_equal, rendered``: a row for each
    maximal conversation and segment of it (turn numbers ``1024 * segment`` and
    on; null without a number), so no row holds an unbounded conversation.
    ``n_turns`` is the whole conversation's; ``n_equal`` counts the equal
    conversations that it stands for.  A turn is rendered as ``<|role|>``, new
    line, text, ``<|end|>``, new line.  An empty table gives no rows; other
    columns are not read.
    """
    turns = logged_turns(conversations)
    kept = bounded(cut(maximal_conversations(prefix_hashes(turns)), "maximal"))
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    parts = turns.join(kept, "conv_id").groupBy("conv_id", "block", "n_turns", "n_equal").agg(
        F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))  # of one block
    return parts.select("conv_id", F.when(F.col("block") != NO_NUMBER, F.col("block")).alias("segment"), "n_turns", "n_equal", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
