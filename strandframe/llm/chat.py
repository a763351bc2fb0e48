"""Dialogues rendered from every participant's side.

For each participant of a conversation the whole dialogue is rendered once more, with that speaker as the assistant,
all others as named users, and a mask over what the assistant says. DataFrame functions only. The result has one row
for each turn and side, with its place in the rendered dialogue, so that a conversation of any length stays spread
over tasks: in order of position, the rows of a side joined are its dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.ordered import carried, dealt

from .common import table

ASSISTANT, SYSTEM, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def _named(role: Column) -> Column:
    return F.concat(F.lit("<|user name="), role, F.lit("|>\n"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, perspective, position, speaker, rendered, start, end, mask_start, mask_end) in code points.

    Turns are ordered by (turn, role, text), nulls first; equal rows are turns of their own. ``system`` and null roles
    speak but are no participants: the first keep their own header, the second are a user named "unknown". A null text
    is empty. mask_start and mask_end enclose what the assistant says, its end mark included; on other rows they
    are both ``end``. A conversation without participants gives no rows, nor do turns whose conversation is null; an
    empty table gives an empty one. Other columns are left out, whatever their names.

    Turns are dealt by range before they meet the sides of their conversation, which go to each range that holds a
    part of it: a conversation of any length stays spread over as many tasks as it has ranges.
    """
    plain = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(text).isNull().alias("_null"))
    plain = plain.filter("conv_id is not null").withColumn("_tie", F.monotonically_increasing_id())
    order = ["_turn", "_role", "_null", "_text", "_tie"]
    stored = dealt(plain, ["conv_id"], order)
    sides = stored.filter(F.col("_role") != system).select(F.col("conv_id").alias("conv_id"), F.col("_role").alias("perspective")).distinct()
    ranges = stored.select("conv_id", "_range").distinct()
    rows = stored.join(ranges.join(sides, "conv_id"), ["conv_id", "_range"])
    rows = rows.withColumn("_mine", F.coalesce(F.col("_role") == F.col("perspective"), F.lit(False)))
    head = F.when(F.col("_mine"), ASSISTANT).when(F.col("_role") == system, SYSTEM).otherwise(_named(F.coalesce("_role", F.lit("unknown"))))
    rows = rows.withColumn("_head", head).withColumn("_size", F.length("_head") + F.length("_text") + len(END))
    placed = carried(rows, ["conv_id", "perspective"], order, {"position": ("sum", F.lit(1)), "start": ("sum", F.col("_size"))})
    placed = placed.withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in ("position", "start")}).withColumn("rendered", F.concat("_head", "_text", F.lit(END)))
    end = F.col("start") + F.length("rendered")
    return placed.select(
        "conv_id", "perspective", "position", F.coalesce("_role", F.lit("unknown")).alias("speaker"), "rendered", "start", end.cast("long").alias("end"),
        F.when(F.col("_mine"), F.col("start") + F.length("_head")).otherwise(end).cast("long").alias("mask_start"), F.when(F.col("_mine"), end - 1).otherwise(end).cast("long").alias("mask_end"),
    )


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH plain AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, text IS NULL AS missing FROM conversations
), sides AS (
  SELECT DISTINCT conv_id, role AS perspective FROM plain WHERE role <> 'system' AND conv_id IS NOT NULL
), headed AS (
  SELECT p.*, s.perspective, coalesce(role = perspective, false) AS mine,
         CASE WHEN coalesce(role = perspective, false) THEN '<|assistant|>' || chr(10)
              WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' || chr(10) END AS head
  FROM plain p JOIN sides s USING (conv_id)
), rendered AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, missing, text)
)
SELECT conv_id, perspective, position, coalesce(role, 'unknown') AS speaker, rendered,
       CAST(start AS BIGINT) AS start, CAST(start + length(rendered) AS BIGINT) AS "end",
       CAST(start + length(CASE WHEN mine THEN head ELSE rendered END) AS BIGINT) AS mask_start,
       CAST(start + length(rendered) - CASE WHEN mine THEN 1 ELSE 0 END AS BIGINT) AS mask_end
FROM placed
"""
