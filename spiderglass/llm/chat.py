"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant
and the others as named users. A turn reads

    <|im_start|>assistant\\n...text...<|im_end|>\\n          the speaker's own turns
    <|im_start|>user name=NAME\\n...text...<|im_end|>\\n     all others' turns

System turns are instructions, not a participant: they stay `system` in every rendering. The mask
marks, as code point ranges (end exclusive), what the model is to learn: the text and end mark of the
speaker's own turns. The mask is told per turn too.

`rotated_turns` gives a row for each turn and perspective (turns stay apart, so a huge conversation is
never gathered); `rotate` joins a perspective's turns into one dialogue, whose size is that of the
dialogue it returns.

Names are roles in which control marks are broken up and line breaks are spaces, so that no role can open
or close a turn; participants are told apart by their roles as they are, so two roles of one name stay two.

Edge cases: a null role is a participant of its own, whose name is "unknown" and whose speaker is null; a null
text is empty; a very long text is copied once for each participant, and a perspective is one row; turns are ordered by turn
(nulls first), then role and text, so ties have one order and repeated rows all count; a conversation
of system turns only has no perspective and gives no row; a null conv_id is a conversation of its own;
control marks inside texts are broken up with a space so that a text cannot open a turn; an empty table
gives no rows; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean, table

# The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _turns(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", _broken(clean("text")).alias("text"))


def _broken(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _name(role: Column) -> Column:
    # A break inside a mark is gone before marks are looked for.
    return _broken(F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+", " "))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n")).when(role.eqNullSafe(speaker), F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), _name(role), F.lit("\n")))


def rotated_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, speaker, turn, role, rendered, learn): each turn as seen from each participant."""
    turns = _turns(rows)
    speakers = turns.where(~F.col("role").eqNullSafe(SYSTEM)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    both = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return both.select("conv_id", "speaker", "turn", "role", F.concat(_head(F.col("role"), F.col("speaker")), "text", F.lit(f"{CLOSE}\n")).alias("rendered"), F.col("role").eqNullSafe(F.col("speaker")).alias("learn"))


def rotate(rows: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, n_own, n_chars, dialogue, mask, turn_mask) for every participant."""
    turns = _turns(rows)
    # One shuffle: a conversation's turns are gathered once and rendered for each of its speakers.
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: ~r.eqNullSafe(SYSTEM))))
    each = whole.select("conv_id", "turns", F.explode(speakers).alias("speaker"))
    part = lambda t: F.struct(_head(t["role"], F.col("speaker")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), t["role"].eqNullSafe(F.col("speaker")).alias("own"))
    each = each.select("conv_id", "speaker", F.transform("turns", part).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["out"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))).otherwise(acc["out"]).alias("out"))

    dialogue = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    own = F.filter("parts", lambda p: p["own"])
    return each.select(
        "conv_id", "speaker", F.size("parts").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_own"), F.length(dialogue).cast("long").alias("n_chars"),
        dialogue.alias("dialogue"), F.array_join(F.aggregate("parts", start, step, lambda acc: acc["out"]), ",").alias("mask"),
        F.array_join(F.transform("parts", lambda p: F.when(p["own"], "1").otherwise("0")), "").alias("turn_mask"),
    )


def op10_perspectives(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'), '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') AS name,
    regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') AS text FROM conversations
),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role IS DISTINCT FROM 'system'),
parts AS (
  SELECT t.conv_id, s.speaker, t.turn, t.role, t.text, t.role IS NOT DISTINCT FROM s.speaker AS own,
    CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10) WHEN t.role IS NOT DISTINCT FROM s.speaker THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || t.name || chr(10) END AS head,
    t.text || '<|im_end|>' AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS stop,
    row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS k
  FROM parts
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own, length(string_agg(head || body || chr(10), '' ORDER BY k)) AS n_chars,
  string_agg(head || body || chr(10), '' ORDER BY k) AS dialogue,
  string_agg(CASE WHEN own THEN (stop - length(body))::VARCHAR || ':' || stop::VARCHAR END, ',' ORDER BY k) AS mask,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY k) AS turn_mask
FROM placed GROUP BY conv_id, speaker
"""
