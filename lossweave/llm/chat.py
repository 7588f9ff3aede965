"""Perspective rotation of multi-party dialogues, with DataFrame functions only.

Every speaker but ``system`` gets a rendering of the dialogue in which the own turns are those of the
assistant, all others those of named users, and system turns stay. The mask lists the stretches of the
rendering (start and stop in characters) that the speaker wrote, each with its end mark: what a model is
trained on. A dialogue of more than ``part_turns`` messages is rendered in consecutive parts, so that no
group grows with the length of a dialogue. Places inside a dialogue are counted without gathering it:
messages are sorted by range over all tasks, numbered inside their task, and shifted by what earlier tasks
hold of the same dialogue.

Defined results: messages come in the order of turn, role and text (nulls first), so ties and repeated rows
have a fixed order and are all rendered; a null role is the speaker ``unknown``; a null text is empty; rows
without a conversation id form one dialogue of their own; control marks inside a text are broken up by a
space; a dialogue of system turns alone has no perspective and gives no row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossweave.llm.tables import pin

BEGIN, END = "<|im_start|>", "<|im_end|>"
UNKNOWN, SYSTEM = "unknown", "system"


def _numbered(messages: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``: the message's number in its dialogue, from 0."""
    columns = [F.col("conv_id"), *(F.col(c).asc_nulls_first() for c in order)]
    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = messages.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    # a number's upper bits name the task, the lower ones count its rows in order
    own = pin(sorted_.withColumn("number", F.monotonically_increasing_id()), "messages")
    held = own.groupBy("conv_id", F.shiftright("number", 33).alias("task")).agg(F.min("number").alias("least"), F.count("*").alias("rows"))
    tasks_of = held.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("task", "least", "rows"))).alias("tasks"))
    task = F.shiftright("number", 33)
    before = F.aggregate(
        F.filter("tasks", lambda t: t["task"] < task), F.lit(0).cast("long"), lambda total, t: total + t["rows"]
    )
    least = F.element_at(F.filter("tasks", lambda t: t["task"] == task), 1)["least"]
    joined = own.alias("m").join(tasks_of.alias("t"), F.col("m.conv_id").eqNullSafe(F.col("t.conv_id")))
    return joined.select("m.*", (F.col("number") - least + before).alias("place")).drop("number")


def _piece(message: Column, perspective: Column) -> Column:
    own = message["speaker"] == perspective
    named = F.concat(F.lit("user name="), message["speaker"])
    head = F.when(message["speaker"] == SYSTEM, SYSTEM).when(own, "assistant").otherwise(named)
    return F.struct(
        own.alias("own"),
        F.concat(F.lit(BEGIN), head, F.lit("\n"), message["body"], F.lit(END), F.lit("\n")).alias("text"),
        F.length(message["body"]).alias("size"),
    )


def perspectives(conversations: DataFrame, part_turns: int = 512) -> DataFrame:
    """(conv_id, perspective, part, rendered, mask, n_messages, n_own): one row per speaker and part."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    placed = _numbered(rows, ["turn", "role", "text"]).select(
        "conv_id",
        "place",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("body"),
    )
    part = F.floor(F.col("place") / part_turns).cast("long").alias("part")
    message = F.struct("place", "speaker", "body")
    parts = placed.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    speakers = placed.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    turned = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    pieces = F.transform("messages", lambda m: _piece(m, F.col("perspective")))
    turned = turned.select("p.conv_id", "perspective", "part", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, stop: int>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece["text"]) - 1  # without the line break
        span = F.struct((stop - len(END) - piece["size"]).alias("start"), stop.alias("stop"))
        spans = F.when(piece["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((stop + 1).alias("at"), spans.alias("spans"))

    return turned.select(
        "conv_id",
        "perspective",
        "part",
        F.array_join(F.col("pieces.text"), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda state: state["spans"]).alias("mask"),
        F.size("pieces").cast("long").alias("n_messages"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
    )


def perspectives_sql(part_turns: int = 512) -> str:
    """The same in SQL, with the mask as text."""
    return f"""WITH m AS (
  SELECT conv_id, coalesce(role, '{UNKNOWN}') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations
), s AS (SELECT DISTINCT conv_id, speaker FROM m WHERE speaker <> '{SYSTEM}'), r AS (
  SELECT s.conv_id, s.speaker AS perspective, place // {part_turns} AS part, place, m.speaker = s.speaker AS own, length(body) AS size,
    '{BEGIN}' || CASE WHEN m.speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN m.speaker = s.speaker THEN 'assistant'
      ELSE 'user name=' || m.speaker END || chr(10) || body || '{END}' || chr(10) AS piece
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place) - 1 AS stop FROM r)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, string_agg(piece, '' ORDER BY place) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(stop - {len(END)} - size AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END, ',' ORDER BY place), '') AS mask,
  count(*) AS n_messages, count(*) FILTER (own) AS n_own
FROM o GROUP BY 1, 2, 3"""
