"""Chat formatting with collapse of cumulative snapshots; DataFrame functions only.

Loggers store a conversation again after each turn. Rolling hashes of turn prefixes find the conversations that
another one goes on from; anti-joins leave the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.plans.store import save

#: Turn numbers that one block of the rolling hash, and one part of a rendered conversation by default, spans.
BLOCK, PART = 256, 512
#: The control tokens; in what is said their first sign is kept apart from the second, so that no text can end a turn.
OPEN, CLOSE, END, APART = "<|", "|>", "<|end|>", "<\u200b|"


def _clean(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls: no turn number counts as -1, no role or text as empty; rows of no conversation go."""
    return turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, a, b) of each conversation and turn number: rows up to that turn, and 128 bits of hash of them.

    The hash is the exclusive or of hashes of (turn, role, text) of distinct rows, so it can be summed in any order: within
    blocks of turn numbers first, then over the blocks of a conversation. A conversation of any length meets no single task
    but with one row for each block.
    """
    row = _clean(turns).select("conv_id", "turn", F.xxhash64("turn", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "turn").alias("b")).distinct()
    each = row.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    blocks = each.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = each.select("conv_id", "block", "turn", F.sum("n").over(inside).alias("n"), F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b"))
    return rolled.join(start, ["conv_id", "block"]).select("conv_id", "turn", (F.col("n") + F.col("n0")).alias("n"), F.col("a").bitwiseXOR(F.col("a0")).alias("a"), F.col("b").bitwiseXOR(F.col("b0")).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one goes on from; of equal ones that of the least id.

    A conversation goes on from another if its rows up to some turn, but not all, are the other's rows. Rows that repeat
    within a conversation count once.
    """
    rolled = save(prefixes(turns), "prefixes")
    whole = rolled.groupBy("conv_id").agg(F.max(F.struct("turn", "n", "a", "b")).alias("end"))
    full = whole.select("conv_id", "end.n", "end.a", "end.b").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = rolled.join(whole.select("conv_id", F.col("end.turn").alias("top")), "conv_id").where("turn < top").select("n", "a", "b").distinct()
    return full.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def _plain(said: Column) -> Column:
    return F.replace(said, F.lit(OPEN), F.lit(APART))


def rendered(turns: DataFrame, part: int | None = PART) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered) of the maximal conversations.

    A row holds `part` turn numbers, numbered from 0, so that a conversation of any length meets no single task; joined in their order
    the rows of a conversation are the whole of it. With `part` None each is one row, however long. Turns are in the order of turn number,
    role and text; control tokens within a role or text are broken up. An empty table gives an empty table.
    """
    keep = maximal(turns)
    number = F.lit(0).cast("long") if part is None else F.floor(F.greatest(F.col("turn"), F.lit(0)) / part)
    rows = _clean(turns).join(keep, "conv_id").withColumn("part", number)
    said = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
    out = rows.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), said.alias("said"))
    return out.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("said", lambda t: F.concat(F.lit(OPEN), _plain(t.role), F.lit(CLOSE + "\n"), _plain(t.text), F.lit(END + "\n"))), "").alias("rendered"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH rows_ AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, max(turn) AS top,
  list(turn::VARCHAR || '/' || role || '/' || text ORDER BY turn, role, text) AS said FROM rows_ GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n, said, top, count(*) AS n_copies FROM convs GROUP BY n, said, top),
best AS (SELECT o.conv_id, o.n, o.n_copies FROM one o WHERE NOT EXISTS (SELECT 1 FROM convs c JOIN rows_ r ON r.conv_id = c.conv_id AND r.turn = o.top WHERE c.n > o.n AND c.said[1] = o.said[1] AND c.said[1:o.n] = o.said AND c.top > o.top))
SELECT r.conv_id, floor(greatest(r.turn, 0) / 512)::BIGINT AS part, max(b.n) AS n_turns, max(b.n_copies) AS n_copies,
  string_agg('<|' || replace(r.role, '<|', '<' || chr(8203) || '|') || '|>' || chr(10) || replace(r.text, '<|', '<' || chr(8203) || '|') || '<|end|>' || chr(10), '' ORDER BY r.turn, r.role, r.text) AS rendered
FROM rows_ r JOIN best b USING (conv_id) GROUP BY 1, 2
"""
