"""Operator 3: multi-party dialogues, rendered once for every speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SYSTEM, UNNAMED = "system", "unknown"


def _plain(text: Column) -> Column:
    """Text that cannot open or close a message of its own."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, slot_turns: int = 1024) -> DataFrame:
    """One row for each conversation, speaker as assistant, and turn.

    Columns: conv_id, speaker, turn, position (from 0), segment, start and end (characters of the rendered
    dialogue, end exclusive), trained (the mask: true where ``speaker`` speaks).  The segments in order of position
    are the dialogue: the speaker's turns as ``assistant``, other speakers' as ``user`` with their name, system turns
    as ``system`` in every rendering.  A conversation without speakers has no rendering.

    Null or blank roles count as one speaker ``unknown``, null texts as empty, null turns come last, null conversation ids
    are one conversation.  Ties in ``turn`` go by role, then text; repeated rows stay.  A dialogue is never one value in
    memory: places and offsets come from slots of ``slot_turns`` turn numbers whose totals are added up.
    """
    role = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit(UNNAMED))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("slot", F.floor(F.coalesce("turn", F.lit(2**62)) / slot_turns))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    views = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.col("role") == F.col("speaker")
    head = F.when(F.col("role") == SYSTEM, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), _plain(F.regexp_replace("role", r"\s+", "_"))))
    segment = F.concat(F.lit("<|im_start|>"), head, F.lit("\n"), _plain(F.col("text")), F.lit("<|im_end|>\n"))
    views = views.select("conv_id", "speaker", "turn", "role", "text", "slot", segment.alias("segment"), own.alias("trained"))
    key = ["conv_id", "speaker"]
    slots = views.groupBy(*key, "slot").agg(F.count("*").alias("n"), F.sum(F.length("segment")).alias("chars"))
    before = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.struct(*key, "slot").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy(*key, "slot").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    views = views.withColumn("k", F.row_number().over(inside) - 1).withColumn("upto", F.sum(F.length("segment")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = views.join(slots, views["conv_id"].eqNullSafe(slots["at.conv_id"]) & (views["speaker"] == slots["at.speaker"]) & (views["slot"] == slots["at.slot"]))
    end = F.col("c0") + F.col("upto")
    return placed.select("conv_id", "speaker", "turn", (F.col("n0") + F.col("k")).alias("position"), "segment", (end - F.length("segment")).alias("start"), end.alias("end"), "trained")


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role, ' '), ''), 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
v AS (SELECT conv_id, speaker, turn, role, text, role = speaker AS trained,
        '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
          ELSE 'user name=' || replace(regexp_replace(role, '\\s+', '_', 'g'), '<|', '< |') END
        || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS segment
      FROM t JOIN s ON conv_id IS NOT DISTINCT FROM c),
n AS (SELECT *, row_number() OVER w - 1 AS position,
        sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS upto
      FROM v WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, speaker, turn, position, segment, CAST(upto - length(segment) AS BIGINT) AS "start", CAST(upto AS BIGINT) AS "end", trained FROM n
"""
