"""Chat logs as training text: snapshots of growing conversations collapse to the longest one.

A logger may store a conversation after every turn, so that one record is a prefix of another.  Every turn gets a
strong hash of its position, role and text; the exclusive or of those up to a turn is the rolling hash of that
prefix (two independent 64-bit halves).  A conversation whose whole hash is a proper prefix of another goes, by
an anti join; of equal conversations the one with the lowest id stays.  The remaining ones are rendered.

Turns are ordered by ``turn``, then role and text; a null turn comes first.  Null roles and texts differ from
empty ones when compared and are rendered as empty.  A repeated row is one more turn.  All rows without a
``conv_id`` form one conversation.  Rendered text comes in parts of at most ``PART_TURNS`` turns, so that a conversation
of any length stays within bounds.  Turns are numbered slot by slot of ``turn`` values: a long conversation is not
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

PART_TURNS = 256
SLOT = 4096  # turn values that are ordered together


def _positioned(turns: DataFrame) -> DataFrame:
    """Turns with ``pos`` from 0 within the conversation, and the slot they were numbered in."""
    keyed = turns.select(
        "conv_id", "turn", "role", "text",
        F.coalesce(F.floor(F.col("turn") / SLOT), F.lit(-(1 << 60))).alias("slot"),
    )
    sizes = keyed.groupBy("conv_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    # A row per slot: what comes before it in its conversation.
    before = sizes.select(
        F.col("conv_id").alias("_conv"), F.col("slot").alias("_slot"),
        (F.sum("n").over(Window.partitionBy("conv_id").orderBy("slot")) - F.col("n")).alias("before"),
    )
    inside = Window.partitionBy("conv_id", "slot").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    numbered = keyed.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(
        before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("slot") == F.col("_slot"))
    ).select("conv_id", "slot", "role", "text", (F.col("before") + F.col("at")).alias("pos"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns in order with the hash of the prefix that ends with them: ``conv_id, pos, role, text, h1, h2``."""
    content = ("pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    hashed = store(
        _positioned(turns).withColumn("t1", F.xxhash64(F.lit("a"), *content)).withColumn("t2", F.xxhash64(*content, F.lit("b"))),
        "chat-turns",
    )
    slots = hashed.groupBy("conv_id", "slot").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    by_slot = Window.partitionBy("conv_id").orderBy("slot")
    before = slots.select(
        F.col("conv_id").alias("_conv"), F.col("slot").alias("_slot"),
        F.bit_xor("s1").over(by_slot).bitwiseXOR(F.col("s1")).alias("b1"),
        F.bit_xor("s2").over(by_slot).bitwiseXOR(F.col("s2")).alias("b2"),
    )
    inside = Window.partitionBy("conv_id", "slot").orderBy("pos")
    rolled = hashed.withColumn("r1", F.bit_xor("t1").over(inside)).withColumn("r2", F.bit_xor("t2").over(inside))
    return rolled.join(
        before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("slot") == F.col("_slot"))
    ).select(
        "conv_id", "pos", "role", "text",
        F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"),
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of conversations that no longer one extends."""
    last = F.max(F.struct("pos", "h1", "h2")).alias("last")
    whole = rolled.groupBy("conv_id").agg(last).select(
        "conv_id", (F.col("last.pos") + 1).alias("n_turns"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"),
    )
    unique = whole.groupBy("n_turns", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")
    )
    # Prefixes that another turn follows; equal ones are one before the shuffle.
    follows = whole.select(F.col("conv_id").alias("_conv"), F.col("n_turns").alias("_n"))
    proper = (
        rolled.join(follows, F.col("conv_id").eqNullSafe(F.col("_conv"))).filter(F.col("pos") + 1 < F.col("_n"))
        .select((F.col("pos") + 1).alias("n_turns"), "h1", "h2").distinct()
    )
    return unique.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, copies, rendered`` of the maximal conversations."""
    rolled = store(prefixes(turns), "chat-prefixes")
    chosen = store(maximal(rolled), "chat-maximal")
    line = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n")
    )
    lines = rolled.select("conv_id", F.floor(F.col("pos") / PART_TURNS).alias("part"), "pos", line.alias("line")).join(
        chosen.select(F.col("conv_id").alias("_conv"), "n_turns", "copies"), F.col("conv_id").eqNullSafe(F.col("_conv"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_join(ordered, "").alias("rendered"))


def op8(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)


#: Equal conversations and proper prefixes as texts of their turns.
OP8_SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    concat(case when role is null then 'n' else 'r' || length(role) || ':' || role end, '|',
           case when text is null then 'n' else 't' || length(text) || ':' || text end) as content,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as pos
  from conversations
), prefix as (
  select *, sha256(string_agg(content, '#') over (partition by conv_id order by pos)) as h,
    count(*) over (partition by conv_id) as n_turns
  from turns
), whole as (
  select n_turns, h, min(conv_id) as conv_id, count(*) as copies from prefix where pos + 1 = n_turns group by n_turns, h
), kept as (
  select w.* from whole w
  where not exists (select 1 from prefix p where p.pos + 1 = w.n_turns and p.n_turns > w.n_turns and p.h = w.h)
)
select k.conv_id, cast(t.pos // 256 as bigint) as part, cast(k.n_turns as bigint) as n_turns, k.copies,
  string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10), '' order by t.pos) as rendered
from kept k join turns t on t.conv_id is not distinct from k.conv_id
group by k.conv_id, t.pos // 256, k.n_turns, k.copies
"""
