"""Operator 9: preference pairs from chosen and rejected conversations, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import let

#: How a turn is rendered.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def turn_text(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(TAIL))


def rendered(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, turn_text), "")


def spans(turns: Column, learned: str) -> Column:
    """Where a completion's loss counts: start:end of what `learned` says, end mark included, in code points, joined by commas."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["role"]) + len(HEAD) + len(MIDDLE)
        end = acc["at"] + F.length(turn_text(turn))
        mine = F.concat(start.cast("string"), F.lit(":"), (end - 1).cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(turn["role"] == learned, F.concat(acc["out"], F.array(mine))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, first, step, lambda acc: F.array_join(acc["out"], ","))


def preferences(turns: DataFrame, pairs: DataFrame | None = None, learned: str = "assistant") -> DataFrame:
    """One row for each pair: the longest common prefix of turns as the prompt, once; both completions with masks.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id; without it an even conversation is the
    chosen partner of the next, odd one. Turns are in order of turn, then role, then text; null roles and texts are
    empty ones; rows with a null conv_id belong to no pair; a repeated row is a turn of its own; a pair of which one
    side has no turns gives no row. Equal conversations give empty completions. An empty table gives no rows. A very
    long text stays whole; a pair's turns are one row of the result, and so one row of a task. Extra columns are not read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said")).where(F.col("conv_id").isNotNull())
    if pairs is None:
        even = F.floor(F.col("conv_id") / 2).cast("long")
        sided = rows.select(even.alias("pair_id"), (even * 2).alias("chosen_id"), (even * 2 + 1).alias("rejected_id"), (F.col("conv_id") != even * 2).alias("is_rejected"), "said")
    else:
        side = lambda c: pairs.select("pair_id", "chosen_id", "rejected_id", F.col(c).alias("conv_id"), F.lit(c == "rejected_id").alias("is_rejected"))
        sided = rows.join(side("chosen_id").unionByName(side("rejected_id")), "conv_id")
    both = sided.groupBy("pair_id", "chosen_id", "rejected_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("is_rejected") == x, F.col("said")))).alias(name) for name, x in (("good", False), ("bad", True))))
    same = lambda a, b: F.transform(a, lambda t, i: (t["role"] == F.get(b, i)["role"]) & (t["text"] == F.get(b, i)["text"]))
    differ = lambda ok: F.coalesce(F.array_position(F.transform(ok, lambda x: F.coalesce(x, F.lit(False))), False), F.lit(0))
    common = let(differ(same(F.col("good"), F.col("bad"))), lambda p: F.when(p == 0, F.size("good")).otherwise(p - 1)).cast("int")
    cut = both.where((F.size("good") > 0) & (F.size("bad") > 0)).withColumn("n_prompt_turns", common)
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("good", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        rendered(rest("good")).alias("chosen"), rendered(rest("bad")).alias("rejected"),
        spans(rest("good"), learned).alias("chosen_spans"), spans(rest("bad"), learned).alias("rejected_spans"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT * FROM t WHERE conv_id = pair_id * 2), b AS (SELECT * FROM t WHERE conv_id = pair_id * 2 + 1),
p AS (
  SELECT pair_id, coalesce(min(CASE WHEN a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text THEN pos END) - 1, max(pos)) AS k
  FROM (SELECT * FROM a WHERE pair_id IN (SELECT pair_id FROM b)) a
  FULL JOIN (SELECT * FROM b WHERE pair_id IN (SELECT pair_id FROM a)) b USING (pair_id, pos) GROUP BY pair_id),
s AS (
  SELECT t.*, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said, conv_id = pair_id * 2 AS good
  FROM t JOIN p USING (pair_id)),
o AS (
  SELECT *, coalesce(sum(length(said)) FILTER (WHERE pos > k) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s)
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, CAST(any_value(k) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE good AND pos <= k), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE good AND pos > k), '') AS chosen,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE NOT good AND pos > k), '') AS rejected,
  coalesce(string_agg((CAST(before AS BIGINT) + length(role) + 5) || ':' || (CAST(before AS BIGINT) + length(said) - 1), ',' ORDER BY pos) FILTER (WHERE good AND pos > k AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((CAST(before AS BIGINT) + length(role) + 5) || ':' || (CAST(before AS BIGINT) + length(said) - 1), ',' ORDER BY pos) FILTER (WHERE NOT good AND pos > k AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY pair_id
"""
