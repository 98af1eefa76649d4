"""Operator 5, chat formatting: event-sourced reconstruction of conversations.

A log holds events of four kinds. Events are partitioned by conversation and put in order of their
sequence number; streamed deltas, edits and regenerations are folded into the final messages, which are
then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.shared import col, read

#: What is written before and after each message.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def final_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", seq: str | None = None, kind: str | None = None) -> DataFrame:
    """(conv, turn, role, text): the messages that stand when all events of a log have been applied.

    Without ``seq`` the turn number orders the log; without ``kind``, or where it is null, an event is a
    message. The kinds, each for one turn of a conversation:

    * ``message`` sets the turn's text and role anew;
    * ``delta`` adds its text to what the turn holds (a turn may begin with one);
    * ``edit`` replaces the text and takes back all later turns that hold events before the edit;
    * ``regenerate`` does the same to a reply: the turn begins again, empty unless it brings a text, and
      deltas that follow fill it.

    So a turn survives if some event of it comes after every edit or regeneration of an earlier turn, and
    only those events count. The role is that of the last counted event that names one. Unknown kinds
    are an error.

    Nulls: a null text adds nothing; a null conversation is a conversation of its own; a null turn or seq
    comes first; a null role stays null. Ties of (seq) are ordered by kind (message, edit, regenerate,
    delta), turn, role and text, so the result is fixed; rows that repeat in all columns apply twice, which
    matters for deltas only. A turn whose final text is empty is kept. An empty table gives no rows. Only
    the named columns are read.

    Very long texts and conversations of many turns are taken whole: events are grouped by turn, and of a
    conversation only one row for each turn is put in order.
    """
    kinds = F.coalesce(col(kind).cast("string"), F.lit("message")) if kind else F.lit("message")
    order = F.when(kinds == "message", 0).when(kinds == "edit", 1).when(kinds == "regenerate", 2).when(kinds == "delta", 3).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), kinds)).cast("int"))
    log = df.select(col(conv).alias("conv"), col(turn).cast("bigint").alias("turn"), F.struct((col(seq) if seq else col(turn)).cast("bigint").alias("seq"), order.alias("kind"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text")).alias("e"))
    turns = log.groupBy("conv", "turn").agg(F.array_sort(F.collect_list("e"), _null_first).alias("events"))
    breaks = F.filter("events", lambda e: e["kind"].isin(1, 2))
    turns = turns.withColumn("cut", F.array_max(F.transform(breaks, lambda e: F.coalesce(e["seq"], F.lit(-(2**63))))))
    # the latest edit or regeneration of any earlier turn; Spark spills a window's rows, however many turns a conversation has
    earlier = Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select("conv", "turn", "events", (F.max("cut").over(earlier) if kind else F.lit(None).cast("bigint")).alias("cut"))
    live = placed.withColumn("events", F.filter("events", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))).where(F.size("events") > 0)
    state = F.aggregate(
        "events", F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text")),
        lambda s, e: F.struct(F.coalesce(e["role"], s["role"]).alias("role"), F.when(e["kind"] == 3, F.concat(s["text"], F.coalesce(e["text"], F.lit("")))).otherwise(F.coalesce(e["text"], F.lit(""))).alias("text")),
    )
    return live.select("conv", "turn", state.alias("s")).select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("s.role").alias(role), F.col("s.text").alias(text))


def _null_first(a, b):
    """Order of events: seq, kind, role, text; nulls come first."""
    out = F.lit(0)
    for name in ("text", "role", "kind", "seq"):
        x, y = a[name], b[name]
        here = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
        out = F.when(here != 0, here).otherwise(out)
    return out


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_messages, rendered): one text for each conversation, its messages in order of turn.

    A message is ``<|role|>``, a line feed, its text, a line feed, ``<|end|>`` and a line feed; the role is
    ``unknown`` where it is null. Markers that occur in a text lose their bar, so a text can't forge one.
    """
    safe = F.replace(F.coalesce(col(text), F.lit("")), F.lit("<|"), F.lit("<"))
    one = F.concat(F.lit(OPEN), F.coalesce(col(role), F.lit("unknown")), F.lit(BETWEEN), safe, F.lit(CLOSE))
    rows = messages.select(col(conv).alias("conv"), F.struct(col(turn).alias("turn"), one.alias("part")).alias("m"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return whole.select(F.col("conv").alias(conv), F.size("ms").alias("n_messages"), F.array_join(F.transform("ms", lambda m: m["part"]), "").alias("rendered"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", seq: str | None = None, kind: str | None = None) -> DataFrame:
    """``final_messages`` of a log, ``render``ed."""
    return render(final_messages(df, conv, turn, role, text, seq, kind), conv, turn, role, text)


def event_log(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seq, kind): a log that leads to the finished messages of conversations(conv_id, turn, role, text).

    Each message is opened and streamed in three deltas. Every third turn first has a draft and, after it, a reply
    that nobody sees, as an edit then takes it back and the rest is streamed. Of the others, every second is streamed
    to its middle, regenerated and streamed anew. A turn's events have 16 sequence numbers of their own. Null texts
    stay empty messages; repeated rows and two rows of one turn aren't expected.
    """
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    third = F.floor(n / 3).cast("int")
    parts = [F.substring(text, 1, third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, n)]
    same = lambda seq, kind, part, role=F.lit(None).cast("string"): F.struct(F.lit(0).alias("up"), role.alias("role"), part.alias("text"), F.lit(seq).alias("at"), F.lit(kind).alias("kind"))
    named, none = F.col("role").cast("string"), F.lit(None).cast("string")
    stray = F.struct(F.lit(1).alias("up"), F.lit("assistant").alias("role"), F.lit("taken back").alias("text"), F.lit(2).alias("at"), F.lit("message").alias("kind"))
    plain = F.array(same(1, "message", none, named), *[same(4 + i, "delta", p) for i, p in enumerate(parts)])
    edited = F.array(same(1, "message", F.concat(F.lit("draft "), text), named), stray, same(3, "edit", parts[0]), *[same(4 + i, "delta", p) for i, p in enumerate(parts[1:])])
    again = F.array(same(1, "message", parts[0], named), same(3, "delta", parts[2]), same(7, "regenerate", none), *[same(8 + i, "delta", p) for i, p in enumerate(parts)])
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    events = F.when(kind.isin(0, 3), edited).when(kind.isin(1, 5), again).otherwise(plain)
    rows = conversations.select("conv_id", "turn", F.explode(events).alias("e"))
    return rows.select("conv_id", (F.col("turn") + F.col("e.up")).alias("turn"), "e.role", "e.text", (F.col("turn") * 16 + F.col("e.at")).cast("bigint").alias("seq"), "e.kind")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt from an ``event_log`` of them; the SQL renders the finished messages themselves."""
    return format_chats(event_log(read(spark, sf_dir, "conversations")), seq="seq", kind="kind")


SQL = """
SELECT conv_id, count(*)::INT AS n_messages,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM conversations GROUP BY conv_id
"""
