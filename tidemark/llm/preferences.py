"""Preference formatting of chosen and rejected conversations, with DataFrame operations only.

Both conversations of a pair are turns with a place; a turn's side is chosen, rejected or both. A turn that both have at the same place, with the same role and
text, is one row after grouping. The first place at which they differ ends the common prefix: turns before it are the
prompt, rendered once; turns from there on make the chosen and the rejected completion. Assistant turns of completions
are what a model learns from, all else is masked.

Turns are put together in pieces of a bounded number of places, in order: nearly every conversation is one piece, and
one with very many turns is dealt over tasks instead of being gathered in one.

A null turn comes after all others, a null role is rendered as `unknown`, a null text as empty; repeated turns of a side
count once, and different turns with one place stand in order of role and text. A pair whose sides are equal has a
prompt only. Pairs with a null id make no rows. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a piece.
PLACES = 256
LAST_PLACE = (1 << 63) - 1


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST_PLACE)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs made of a table of conversations: pair_id, side, turn, role, text.

    Conversations 2n and 2n + 1 are partners. Each is chosen in a pair of its own id; its rejected side is itself up to
    its last assistant turn, and from there the partner's turns from the partner's last assistant turn on. A
    conversation without an assistant turn, or whose partner has none, makes no pair.
    """
    turns = _turns(conversations)
    replies = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max("turn").alias("last"))
    partner = replies.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last").alias("other_last"))
    pairs = replies.join(partner, "conv_id")
    own = turns.join(pairs, "conv_id").withColumn("pair_id", F.col("conv_id"))
    side = F.when(F.col("turn") < F.col("last"), "both").otherwise("chosen")
    kept = own.select("pair_id", side.alias("side"), "turn", "role", "text")
    # Of a partner, turns from its last reply on, at the places that the reply has in the chosen conversation.
    tail = own.where(F.col("turn") >= F.col("last")).select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"),
        F.lit("rejected").alias("side"),
        F.when(F.col("turn") == LAST_PLACE, F.col("turn")).otherwise(F.col("turn") - F.col("last") + F.col("other_last")).alias("turn"),
        "role",
        "text",
    )
    return kept.unionByName(tail)


def format_preferences(turns: DataFrame, places: int = PLACES) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), piece, n_turns, text, loss_spans from pairs' turns.

    The texts of a part's pieces, in order, are the part. loss_spans are the stretches (start, end in code points of
    the piece) that count in the loss; a prompt has none.
    """
    in_sides = [
        F.max(F.col("side") != "rejected").alias("in_chosen"),
        F.max(F.col("side") != "chosen").alias("in_rejected"),
    ]
    merged = turns.groupBy("pair_id", "turn", "role", "text").agg(*in_sides)
    differs = ~(F.col("in_chosen") & F.col("in_rejected"))
    ends = turns.groupBy("pair_id", "turn", "role", F.xxhash64("text").alias("digest"), F.length("text").alias("n")).agg(*in_sides)
    ends = ends.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("end"))
    in_prompt = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    parts = F.when(in_prompt, F.array(F.lit("prompt"))).otherwise(
        F.array_compact(F.array(F.when(F.col("in_chosen"), F.lit("chosen")), F.when(F.col("in_rejected"), F.lit("rejected"))))
    )
    placed = merged.join(ends, "pair_id").select(
        "pair_id", F.explode(parts).alias("part"), F.expr(f"(turn - pmod(turn, {places})) div {places}").alias("piece"), "turn", "role", "text"
    )
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    turn = F.struct(
        "turn", "role", "text", head.alias("head"), learned.alias("learned"), F.length(head).alias("before"), F.length("text").alias("size")
    )
    pieces = placed.groupBy("pair_id", "part", "piece").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.text, F.lit("\n"))), "")

    def add(state, t):
        start = state.at + t.before
        span = F.struct(start.alias("start"), (start + t.size).alias("end"))
        spans = F.when(t.learned, F.concat(state.spans, F.array(span))).otherwise(state.spans)
        return F.struct((start + t.size + 1).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda state: state.spans)
    return pieces.select(
        "pair_id", "part", F.col("piece").cast("long").alias("piece"), F.size("turns").alias("n_turns"), rendered.alias("text"), spans.alias("loss_spans")
    )


def paired_completions(conversations: DataFrame) -> DataFrame:
    """The formatted pairs of a table of conversations, with loss_spans as text: start-end,start-end."""
    formatted = format_preferences(reply_pairs(conversations))
    shown = F.transform("loss_spans", lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string")))
    return formatted.withColumn("loss_spans", F.array_join(shown, ","))


#: The same as SQL, with running sums of lengths in place of a fold.
SQL = r"""
WITH t AS (
  SELECT conv_id, COALESCE(turn, 9223372036854775807) AS turn, COALESCE(role, 'unknown') AS role, COALESCE(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, MAX(turn) AS l FROM t WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT a.conv_id, a.l, b.l AS o FROM r a JOIN r b ON b.conv_id = xor(a.conv_id, 1)),
own AS (SELECT t.*, p.l, p.o FROM t JOIN p USING (conv_id)),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM own
  UNION SELECT conv_id, 'rejected', turn, role, text FROM own WHERE turn < l
  UNION SELECT xor(conv_id, 1), 'rejected', CASE WHEN turn = 9223372036854775807 THEN turn ELSE turn - l + o END, role, text
  FROM own WHERE turn >= l),
lone AS (
  SELECT pair_id, turn, role, text FROM sides GROUP BY ALL HAVING COUNT(*) = 1),
ends AS (SELECT pair_id, MIN(turn) AS e FROM lone GROUP BY pair_id),
parts AS (
  SELECT DISTINCT s.pair_id, CASE WHEN e IS NULL OR turn < e THEN 'prompt' ELSE side END AS part, turn // 256 AS piece,
         turn, role, text
  FROM sides s LEFT JOIN ends USING (pair_id)),
placed AS (
  SELECT *, COALESCE(SUM(length(role) + length(text) + 6) OVER (
           PARTITION BY pair_id, part, piece ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + length(role) + 5 AS s
  FROM parts)
SELECT pair_id, part, CAST(piece AS BIGINT) AS piece, CAST(COUNT(*) AS INTEGER) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS text,
       COALESCE(string_agg(CASE WHEN part <> 'prompt' AND role = 'assistant'
                           THEN CAST(s AS BIGINT) || '-' || CAST(s + length(text) AS BIGINT) END, ',' ORDER BY turn, role, text), '') AS loss_spans
FROM placed GROUP BY pair_id, part, piece
"""
