"""Chat formatting from an event log, with DataFrame functions only.

A conversation is a log of events in the order of ``seq``:

* ``start`` opens message ``message`` with its role (``text`` is ignored);
* ``delta`` adds ``text`` to the end of the message;
* ``edit`` replaces what the message says so far by ``text``;
* ``regenerate`` empties the message, its deltas follow.

Folding the log gives the final messages, which the template renders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"
LEARNED_ROLE = "assistant"
# Template: <s>[role]text</s> for every message, controls inside role and text escaped.
OPEN, HEAD, BODY, CLOSE = "<s>", "[", "]", "</s>"
# An escaped text has none of these characters but those of the escapes themselves.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of an event log.

    ``events``: conv_id, seq, message, kind, role, text. Events of equal ``seq`` in a
    message apply by kind, then text. A message without a start has a null role, one
    without text is empty; null texts add nothing. Repeated events apply twice.
    """
    own = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "text")
    # What an edit or a new try wipes out is everything before the last of them.
    wiped = F.count_if(F.col("kind").isin(EDIT, REGENERATE)).over(
        own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = events.withColumn("version", wiped)
    said = F.when(F.col("kind").isin(DELTA, EDIT), F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))
    version = kept.groupBy("conv_id", "message", "version").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda e: e["text"]), "").alias("text"),
        F.max_by("role", F.when(F.col("kind") == START, F.struct("seq", "role"))).alias("role"))
    return version.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("version"))).alias("role"),
        F.max_by("text", "version").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one string per conversation.

    ``loss_spans`` are the code points of the assistant's texts in ``formatted``, which
    is what a model is to learn. Messages follow by number; a null role is empty.
    """
    role = F.coalesce("role", F.lit(""))
    shown = messages.select(
        "conv_id", "message", (role == LEARNED_ROLE).alias("learned"),
        F.concat(F.lit(OPEN + HEAD), escape(role), F.lit(BODY)).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body")).select(
        "conv_id", "message", "learned", F.char_length("head").alias("head_chars"), F.char_length("body").alias("body_chars"),
        F.concat("head", "body", F.lit(CLOSE)).alias("shown"))
    so_far = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.char_length("shown").cast("long")).over(so_far) - len(CLOSE)
    placed = shown.withColumn("end", end).withColumn("start", F.col("end") - F.col("body_chars"))
    span = F.when(F.col("learned"), F.struct("start", "end"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message", "shown"))), lambda m: m["shown"]), "")
        .alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, learned): the messages that rendered strings hold.

    ``formatted`` is what ``render`` gives; ``learned`` tells whether the loss mask
    covers the text.
    """
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda p: p.startswith(OPEN + HEAD))
    body = F.substring_index("part", BODY, -1)
    head = F.substring_index("part", BODY, 1)
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = (formatted.select("conv_id", F.posexplode(parts).alias("place", "part"))
             .withColumn("end", F.sum(F.char_length("part").cast("long") + len(CLOSE)).over(so_far) - len(CLOSE))
             .withColumn("start", F.col("end") - F.char_length(body)))
    spans = formatted.select(F.col("conv_id").alias("of"), F.inline("loss_spans"))
    spans = spans.select("of", F.col("start").alias("from"), F.col("end").alias("to"))
    covered = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("from")) & (F.col("end") == F.col("to"))
    return turns.join(spans, covered, "left").select(
        "conv_id", "place", unescape(F.substring(head, len(OPEN + HEAD) + 1, 1 << 30)).alias("role"),
        unescape(body).alias("text"), F.col("from").isNotNull().alias("learned"))


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log that would have led to ``conversations`` (conv_id, turn, role, text).

    Every row is a message, started and then streamed line by line. Rows of the same
    turn follow by role and text, repeated rows are messages of their own; nulls count
    as empty.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                empty("role"), empty("text")).withColumn("message", F.row_number().over(order).cast("long"))
    lines = F.transform(F.split("text", "(?<=\n)", -1), lambda line: F.struct(
        F.lit(DELTA).alias("kind"), F.lit(None).cast("string").alias("role"), line.alias("text")))
    opened = F.array(F.struct(F.lit(START).alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")))
    return rows.select("conv_id", "message", F.posexplode(F.concat(opened, lines)).alias("step", "e")).select(
        "conv_id", (F.shiftleft("message", 31) + F.col("step")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per rendered conversation: digests of what is read back from it."""
    message = F.struct("place", "role", "text", "learned")
    turns = read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("turns"))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sizes = formatted.select(F.col("conv_id").alias("of"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return turns.withColumn("learned", learned).join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars")
