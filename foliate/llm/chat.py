"""Chat formatting by perspective rotation: every participant in turn is the assistant, all others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each perspective and turn: the rendered segment, its role there, its name and its loss mask.

    Segments of a (conv_id, perspective) joined in order of turn, seq give the dialogue; a mask of 1 marks the segment
    as the assistant's own. Rows stay apart, so a conversation of any length is never gathered in one task: only its
    participants are, of which there are as many as distinct roles. System turns are shown to all and no participant.

    A null role counts as "unknown", null text as empty, null conversation ids form one conversation, null turns come
    first. Repeated rows are rendered as often as they occur, numbered by seq. A conversation of system turns only has
    no perspective and gives no row. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("n"))
    people = rows.where("speaker <> 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    shown = rows.join(people, rows.conv_id.eqNullSafe(people.of)).withColumn("seq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(":"), name), F.lit("")), F.lit("|>\n"))
    return shown.select(
        "conv_id", "perspective", "turn", "seq", role.alias("role"), name.alias("name"),
        F.concat(head, "text", F.lit("\n")).alias("segment"), F.length(head).cast("long").alias("content_from"),
        (F.length(head) + F.length("text")).cast("long").alias("content_to"), F.when(own, 1).otherwise(0).cast("long").alias("loss_mask"),
    )


ROTATE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, speaker, text) AS seq FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT n.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ':' || speaker ELSE '' END || '|>' || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, CAST(seq AS BIGINT) AS seq, role, name, head || text || chr(10) AS segment,
       CAST(length(head) AS BIGINT) AS content_from, CAST(length(head) + length(text) AS BIGINT) AS content_to,
       CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS loss_mask
FROM h
"""
