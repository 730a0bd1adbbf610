"""Chat formatting: every participant's perspective on a dialogue.

For each participant the dialogue is rendered with that speaker as assistant and the other speakers as
named users; the mask is 1 where the assistant speaks. A dialogue is a run of segments, one a turn, with
their places in the whole, so that no conversation has to fit into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Tables, summed_before

#: Roles that set the scene but don't take part.
NARRATORS = ("system",)
#: Stands for a null role.
UNNAMED = "unknown"


def plain(text: Column) -> Column:
    """Text in which nothing looks like a mark: `<|` is parted by a blank, so that neither roles nor texts can forge a turn."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def header(speaker: Column, perspective: Column) -> Column:
    """What stands before a turn's text."""
    role = F.when(speaker.isin(*NARRATORS), speaker).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.replace(plain(speaker), F.lit("|>"), F.lit("| >"))))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rotations(conversations: DataFrame) -> DataFrame:
    """A row a (conversation, perspective, turn): conv_id, perspective, turn, speaker, name, segment, mask, begin, end.

    perspective: a participant (each role of the conversation but narrators). name: the speaker's name
    where it is a user here, else null. segment: header, text and end mark; begin and end: its characters
    in the rendered dialogue; mask: 1 if the assistant speaks. Turns go by (turn, role, text), null turns as 0. A null role
    is the participant `unknown`, null text is empty, rows of a null conv_id are one conversation,
    repeated rows repeat their segments, and a conversation of narrators only has no perspective. Marks within roles
    and texts are broken up. A conversation of any length, also one whose turns all have one number, is spread over tasks.
    """
    tables = Tables()
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit(UNNAMED)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    who = rows.where(~F.col("speaker").isin(*NARRATORS)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    speaks = F.col("speaker") == F.col("perspective")
    segment = F.concat(header(F.col("speaker"), F.col("perspective")), plain(F.col("text")), F.lit("<|end|>\n"))
    parts = tables.stored(seen.withColumn("length", F.length(segment).cast("long")), "turns")
    at = summed_before(parts, "length", ["conv_id", "perspective"], ["turn", "speaker", "text"], "begin", tables)
    return at.select("conv_id", "perspective", "turn", "speaker", F.when(~speaks & ~F.col("speaker").isin(*NARRATORS), F.col("speaker")).alias("name"), segment.alias("segment"), F.when(speaks, 1).otherwise(0).alias("mask"), "begin", (F.col("begin") + F.col("length")).alias("end"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, text (the rendered dialogue), spans (begin and end of what the assistant says).

    For conversations whose rendering fits into a row; rotations() has no such bound.
    """
    one = F.sort_array(F.collect_list(F.struct("begin", "segment")))
    spans = F.sort_array(F.collect_list(F.when(F.col("mask") == 1, F.struct("begin", "end"))))
    return rotations(conversations).groupBy("conv_id", "perspective").agg(F.array_join(F.transform(one, lambda x: x.segment), "").alias("text"), spans.alias("spans"))


ORACLE = """
WITH c AS (SELECT conv_id, coalesce(turn, 0)::BIGINT AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
p AS (
  SELECT c.*, w.perspective,
    '<|' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(replace(speaker, '<|', '< |'), '|>', '| >') END
    || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS segment
  FROM c JOIN who w ON c.conv_id IS NOT DISTINCT FROM w.conv_id),
e AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM p)
SELECT conv_id, perspective, turn, speaker,
  CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name, segment,
  CASE WHEN speaker = perspective THEN 1 ELSE 0 END AS mask, "end" - length(segment) AS begin, "end"
FROM e
"""
