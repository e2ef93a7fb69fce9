"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as
named users and system turns as system. Masks mark the characters to train on: the content and end mark of the
speaker's own turns. Rows are turns, so that a conversation of any length is never one task's string; offsets come
from sums per block of ``BLOCK`` turns and then within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 1024
SYSTEM = "system"


def _length(c: str) -> Column:
    return F.char_length(c).cast("long")


def rotate(turns: DataFrame) -> DataFrame:
    """One row per turn and participant of its conversation, from ``turns(conv_id, turn, role, text)``.

    Columns: conv_id, speaker, turn, role (assistant, user or system), name, segment (the rendered turn), start_char and
    end_char of the segment in the whole rendering, mask_start and mask_end (equal where nothing is trained on).
    A null role is a participant named ``unknown``; a null text renders as empty; a null turn comes first; rows without
    conversation id form one conversation. Turns of one number are ordered by name and text, repeated rows stay. A
    conversation of system turns only has no participant and gives no rows. Other columns aren't read.
    """
    t = turns.select("conv_id", F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    speakers = t.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("name").alias("speaker")).distinct()
    rows = t.join(speakers, F.expr("conv_id <=> of")).drop("of")
    role = F.when(F.col("name") == F.col("speaker"), "assistant").when(F.col("name") == SYSTEM, SYSTEM).otherwise("user")
    rows = rows.withColumn("role", role).withColumn("head", F.concat(F.lit(START), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n")))
    rows = rows.withColumn("segment", F.concat("head", "content", F.lit(END))).withColumn("n", _length("segment"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "speaker"]
    sums = rows.groupBy(*key, "block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), before.alias("before"))
    inner = W.partitionBy(*key, "block").orderBy("turn", "name", "content").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("n").over(inner)).join(sums, F.expr("conv_id <=> c and speaker = s and block = b"))
    end = F.col("before") + F.col("inside")
    rows = rows.withColumn("end_char", end).withColumn("start_char", end - F.col("n"))
    own = F.col("role") == "assistant"
    mask_start = F.when(own, F.col("start_char") + _length("head")).otherwise(F.col("end_char"))
    return rows.select("conv_id", "speaker", "turn", "role", "name", "segment", "start_char", "end_char", mask_start.alias("mask_start"), F.col("end_char").alias("mask_end"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.withColumn("segment_md5", F.md5("segment")).drop("segment")


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS content
  FROM conversations
), s AS (SELECT DISTINCT conv_id AS of_conv, name AS speaker FROM t WHERE name <> '{SYSTEM}'),
r AS (
  SELECT t.*, speaker, CASE WHEN name = speaker THEN 'assistant' WHEN name = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role
  FROM t JOIN s ON conv_id IS NOT DISTINCT FROM of_conv
), h AS (
  SELECT *, '{START}' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM r
), g AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn, name, content ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char FROM g
)
SELECT conv_id, speaker, turn, role, name, end_char - length(segment) AS start_char, end_char,
  CASE WHEN role = 'assistant' THEN end_char - length(segment) + length(head) ELSE end_char END AS mask_start,
  end_char AS mask_end, md5(segment) AS segment_md5
FROM o
"""
