"""Chat formatting by multi-party perspective rotation, with DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as `assistant`, every other
participant as a user of that name, and system turns as they are, in the public ChatML layout. A mask lists the spans of
characters that a model should learn: the content and end mark of the assistant's turns.

A long conversation is rendered in segments of SEGMENT turn numbers, each with the place (start_char) where it stands in
the whole rendering, so no task ever holds more than a segment of a conversation; the segments in order, put together,
are the rendering. Turns are gathered into segments once and then joined with the conversation's participants, which
were counted before; the places come from sums over segments, not turns.

Order in a conversation is by turn, then role, then text; turns without a number come last, in a segment of their own.
Defined cases: a null text is empty; a null role is the participant `unknown`; roles that differ in case or outer space
are one; a conversation of system turns only has no participant and so no rows; a null conv_id is a conversation of its
own; equal turns are all rendered; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, table, text_of

#: Turn numbers in a segment, and segments in a block whose lengths are summed up first.
SEGMENT, BLOCK = 64, 1024
START, END = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, perspective, segment, n_turns, start_char, rendered, mask (spans of characters inside rendered)."""
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.nullif(F.lower(F.trim("role")), F.lit("")), F.lit("unknown")).alias("role"),
        text_of("text").alias("text"),
        F.coalesce(F.floor(F.col("turn") / segment), F.lit((1 << 62) // segment)).cast("long").alias("segment"),
    )
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")
    parts = said.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    speakers = said.filter("role <> 'system'").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).agg(F.lit(1).alias("_one"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    views = salted_join(parts, speakers, same, ["segment"]).drop("_conv", "_one")

    own = lambda t: t.role == F.col("perspective")
    head = lambda t: F.concat(
        F.lit(START),
        F.when(own(t), "assistant").when(t.role == "system", "system").otherwise(F.concat(F.lit("user name="), t.role)),
        F.lit("\n"),
    )
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t.text, F.lit(END)).alias("body"), own(t).alias("own")))
    views = views.withColumn("pieces", pieces)
    # the place before each piece, by one pass over the lengths
    walk = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s.at + F.length(p["head"]) + F.length(p.body) + 1).alias("at"),
            F.when(
                p.own,
                F.concat(
                    s.spans,
                    F.array(F.struct((s.at + F.length(p["head"])).alias("start"), (s.at + F.length(p["head"]) + F.length(p.body)).alias("end"))),
                ),
            )
            .otherwise(s.spans)
            .alias("spans"),
        ),
    )
    done = views.withColumn("walk", walk).select(
        "conv_id",
        "perspective",
        "segment",
        F.size("pieces").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p.body, F.lit("\n"))), "").alias("rendered"),
        F.col("walk.spans").alias("mask"),
    )
    placed = places(said, speakers)
    met = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_view")) & (F.col("segment") == F.col("_segment"))
    return done.join(placed, met).select("conv_id", "perspective", F.col("nth").alias("segment"), "n_turns", "start_char", "rendered", "mask")


def places(said: DataFrame, speakers: DataFrame) -> DataFrame:
    """_conv, _view, _segment, nth (of the segments that the conversation has) and start_char (of its rendering), from
    lengths alone: sums over blocks of segments first, then inside each block."""
    name = lambda role: F.when(role == "system", F.length(role)).otherwise(F.length(role) + len("user name="))
    frame = len(START) + len(END) + 2
    counted = said.groupBy("conv_id", "segment", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    parts = counted.groupBy("conv_id", "segment").agg(
        F.sum(F.col("chars") + F.col("n") * (name(F.col("role")) + frame)).alias("chars"), F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("turns")
    )
    own = F.coalesce(F.col("turns")[F.col("perspective")], F.lit(0)) * (len("assistant") - name(F.col("perspective")))
    met = F.col("conv_id").eqNullSafe(F.col("_conv"))
    sizes = salted_join(parts, speakers, met, ["segment"]).select(
        "_conv", F.col("perspective").alias("_view"), F.col("segment").alias("_segment"), F.floor(F.col("segment") / BLOCK).alias("_block"), (F.col("chars") + own).alias("chars")
    )
    before = lambda *key: Window.partitionBy("_conv", "_view", *key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    blocks = sizes.groupBy("_conv", "_view", "_block").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(
        F.col("_conv").alias("_c"), F.col("_view").alias("_v"), F.col("_block").alias("_b"),
        count("chars", before("_block")).alias("chars_before"), count("n", before("_block")).alias("n_before"),
    )
    met = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_view") == F.col("_v")) & (F.col("_block") == F.col("_b"))
    inside = before("_block", "_segment")
    return sizes.join(blocks, met).select(
        "_conv", "_view", "_segment",
        (F.col("n_before") + count(F.lit(1), inside)).cast("int").alias("nth"), (F.col("chars_before") + count("chars", inside)).alias("start_char"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m.start.cast("string"), F.lit("-"), m.end.cast("string"))), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


SQL = {
    "op1_chat_format": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS role, coalesce(text, '') AS text,
                   coalesce(CAST(floor(turn / {SEGMENT}.0) AS BIGINT), {(1 << 62) // SEGMENT}) AS part
            FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
        pieces AS (
            SELECT s.conv_id, p.perspective, s.part, s.role = p.perspective AS own,
                   '{START}' || CASE WHEN s.role = p.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system'
                                     ELSE 'user name=' || s.role END || chr(10) AS head,
                   s.text || '{END}' AS body,
                   row_number() OVER (PARTITION BY s.conv_id, p.perspective ORDER BY s.turn NULLS LAST, s.role, s.text) AS nth
            FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        placed AS (
            SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY nth) - length(body) - 1 AS start
            FROM pieces),
        parts AS (
            SELECT conv_id, perspective, part, CAST(count(*) AS INT) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY nth) AS rendered,
                   coalesce(string_agg(CASE WHEN own THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY nth), '') AS mask
            FROM placed GROUP BY ALL)
        SELECT conv_id, perspective,
               CAST(row_number() OVER (PARTITION BY conv_id, perspective ORDER BY part) - 1 AS INT) AS segment, n_turns,
               CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char,
               rendered, mask
        FROM parts"""
}
