"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation becomes the prompt.

Conversations that open with the same turn (role and text) are answers to one prompt: the one with the smallest conv_id is
the chosen, every other one is rejected against it. Turns are compared place by place; the first place where role or text
differ, or where one conversation has ended, ends the prompt, which is rendered once. The turns after it are the paired
completions. A completion's mask lists the character spans that bear loss: the texts of assistant turns with their end mark.

Every conversation's turns come together once, as a row. An opening's chosen conversation is joined to all that share it, a
very common one by several tasks (``salted_join``), and each pair is compared within its row. So the pairs of a common opening
are as many as its conversations, and only a single conversation's turns ever come together.

Results for unusual input: turns without conv_id or turn number are left out; a null role or text is the empty string; of
turns with one number the order is by role and text, and exact repeats count once; when the chosen is a beginning of the
rejected (or the other way round) its completion is empty; a conversation that shares its opening with no other is a row
with null rejected_id, no prompt, and all its turns as the chosen completion; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..runtime import materialise

OPEN, MIDDLE, CLOSE, LEARNED = "<|", "|>\n", "<|end|>\n", "assistant"


def talks(conversations: DataFrame) -> DataFrame:
    """(conv_id, opening, turns): each conversation's turns (role, text) in order, and the hash of the first."""
    clean = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.array_sort(F.array_distinct(F.collect_list("t"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    told = clean.groupBy("conv_id").agg(turns.alias("turns"))
    return told.select("conv_id", F.sha2(F.concat(F.col("turns")[0]["role"], F.lit("\x00"), F.col("turns")[0]["text"]), 256).alias("opening"), "turns")


def _rendered(role: str | Column, text: str | Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def pairs(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): both sides' turns; rejected_id is null for a conversation without a partner."""
    told = materialise(talks(conversations))
    slim = told.select("conv_id", "opening")
    first = slim.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("places"))
    alone = first.where("places = 1").select("chosen_id")
    first = first.where("places > 1").join(told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    both = salted_join(told, first, ["opening"], ["conv_id"], slim.count()).where("conv_id <> chosen_id")
    none = told.join(alone, told["conv_id"] == alone["chosen_id"]).select("chosen_id", F.lit(None).cast(told.schema["conv_id"].dataType).alias("rejected_id"), F.col("turns").alias("chosen"), F.array().cast("array<struct<role:string,text:string>>").alias("rejected"))
    return both.select("chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected")).unionByName(none)


def preferences(conversations: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for every pair.

    Masks are arrays of (start, end) in characters of the completion.
    """
    longest = F.greatest(F.size("chosen"), F.size("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))  # the shorter one ends in nulls
    fork = F.array_position(same, False)
    per = pairs(conversations).withColumn("prompt_turns", F.when(fork > 0, fork - 1).otherwise(longest).cast("long"))

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: _rendered(t["role"], t["text"])), "")

    def completion(side: str) -> Column:
        return F.filter(side, lambda t, place: place >= F.col("prompt_turns"))

    def mask(side: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)))
            end = begin + F.length(F.concat(t["text"], F.lit(CLOSE)))
            spans = F.when(t["role"] == LEARNED, F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        return F.aggregate(completion(side), start, step)["spans"]

    prompt = F.filter("chosen", lambda t, place: place < F.col("prompt_turns"))
    return per.select("chosen_id", "rejected_id", "prompt_turns", text(prompt).alias("prompt"), text(completion("chosen")).alias("chosen"), text(completion("rejected")).alias("rejected"), mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"))


def digests(conversations: DataFrame) -> DataFrame:
    """Preferences with texts as SHA-256, and the number of characters that bear loss."""
    p = preferences(conversations)
    loss = {f"{s}_loss_chars": F.aggregate(f"{s}_mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]) for s in ("chosen", "rejected")}
    return p.select("chosen_id", "rejected_id", "prompt_turns", *(F.sha2(s, 256).alias(f"{s}_sha256") for s in ("prompt", "chosen", "rejected")), *(c.alias(n) for n, c in loss.items()))


SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, role, text FROM
  (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
o AS (SELECT conv_id, min(conv_id) OVER w AS chosen_id, count(*) OVER w AS n FROM t WHERE place = 0 WINDOW w AS (PARTITION BY role, text)),
p AS (SELECT chosen_id, CASE WHEN n > 1 THEN conv_id END AS rejected_id FROM o WHERE conv_id <> chosen_id OR n = 1),
a AS (SELECT p.*, place, role, text FROM p JOIN t ON conv_id = chosen_id),
b AS (SELECT p.*, place, role, text FROM p JOIN t ON conv_id = rejected_id),
j AS (SELECT coalesce(a.chosen_id, b.chosen_id) AS chosen_id, coalesce(a.rejected_id, b.rejected_id) AS rejected_id, coalesce(a.place, b.place) AS place,
  a.role AS ra, a.text AS ta, b.role AS rb, b.text AS tb FROM a FULL JOIN b ON a.chosen_id = b.chosen_id AND a.rejected_id = b.rejected_id AND a.place = b.place),
f AS (SELECT *, coalesce(min(CASE WHEN ra IS DISTINCT FROM rb OR ta IS DISTINCT FROM tb THEN place END) OVER w, max(place) OVER w + 1) AS fork FROM j WINDOW w AS (PARTITION BY chosen_id, rejected_id))
SELECT chosen_id, rejected_id, CAST(any_value(fork) AS BIGINT) AS prompt_turns,
  sha256(coalesce(string_agg('<|' || ra || '|>' || chr(10) || ta || '<|end|>' || chr(10), '' ORDER BY place) FILTER (place < fork AND ra IS NOT NULL), '')) AS prompt_sha256,
  sha256(coalesce(string_agg('<|' || ra || '|>' || chr(10) || ta || '<|end|>' || chr(10), '' ORDER BY place) FILTER (place >= fork AND ra IS NOT NULL), '')) AS chosen_sha256,
  sha256(coalesce(string_agg('<|' || rb || '|>' || chr(10) || tb || '<|end|>' || chr(10), '' ORDER BY place) FILTER (place >= fork AND rb IS NOT NULL), '')) AS rejected_sha256,
  CAST(coalesce(sum(length(ta) + 8) FILTER (place >= fork AND ra = 'assistant'), 0) AS BIGINT) AS chosen_loss_chars,
  CAST(coalesce(sum(length(tb) + 8) FILTER (place >= fork AND rb = 'assistant'), 0) AS BIGINT) AS rejected_loss_chars
FROM f GROUP BY chosen_id, rejected_id
"""
