"""Chat formatting with a loss mask, and its exact way back. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweft.llm.common import placed

#: The control strings of the template.
BEGIN, END, ROLE, BODY, NEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]"
#: Control strings that a text may not show as they are: those above and the instruction marks of common templates.
AFTER_ANGLE, AFTER_SQUARE = r"\\*/?s>", r"\\*(?:/?(?:INST|ROLE|SYS)|TURN)\]"
LEARNED = "assistant"
#: Turn numbers of a conversation that one task sorts at a time.
SEGMENT = 64
SPANS = "array<struct<start:bigint,stop:bigint>>"


def escape(text: Column) -> Column:
    """The text with one backslash more after the bracket of every control string; ``unescape`` takes it away."""
    return F.regexp_replace(text, rf"(<(?={AFTER_ANGLE})|\[(?={AFTER_SQUARE}))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=<)\\(?={AFTER_ANGLE})|(?<=\[)\\(?={AFTER_SQUARE})", "")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def merged(messages: Column) -> Column:
    """Messages (role, texts) with neighbours of the same role made one; linear in their number."""

    def runs(m: Column) -> Column:
        first = lambda i: (i == 0) | ~F.get(m, i)["role"].eqNullSafe(F.get(m, i - 1)["role"])
        begins = F.filter(F.sequence(F.lit(0), F.size(m) - 1), first)
        texts = lambda s, at, j: F.flatten(F.transform(F.slice(m, at + 1, F.coalesce(F.get(s, j + 1), F.size(m)) - at), lambda x: x["texts"]))
        return bound(begins, lambda s: F.transform(s, lambda at, j: F.struct(F.get(m, at)["role"].alias("role"), texts(s, at, j).alias("texts"))))

    return bound(messages, runs)


def mask_spans(messages: Column) -> Column:
    """Byte spans [start, stop) of the learned texts in the formatted conversation."""
    head = F.octet_length(F.lit(BEGIN + ROLE + BODY))
    lead = lambda m, k: F.when(k == 0, head + F.octet_length(m["role"])).otherwise(len(NEXT))
    tail = lambda m, k: F.when(k == F.size(m["texts"]) - 1, len(END)).otherwise(0)
    piece = lambda m, x, k: F.struct(lead(m, k).cast("long").alias("lead"), F.octet_length(x).cast("long").alias("n"), tail(m, k).cast("long").alias("tail"), (m["role"] == LEARNED).alias("learned"))
    pieces = F.flatten(F.transform(messages, lambda m: F.transform(m["texts"], lambda x, k: piece(m, x, k))))
    size = lambda p: p["lead"] + p["n"] + p["tail"]
    span = lambda at, p: F.array(F.struct((at + p["lead"]).alias("start"), (at + p["lead"] + p["n"]).alias("stop")))
    return placed(pieces, size, lambda at, p: F.when(p["learned"], span(at, p)).otherwise(F.array().cast(SPANS)), SPANS)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_messages) per conversation.

    A message is ``<s>[ROLE]role[/ROLE]text</s>``; neighbouring turns of one role share a message, their texts divided by
    ``[TURN]``. Control strings inside texts and roles get a backslash, so the format can be read back (``read_back``).
    ``loss_spans`` are byte spans of the assistant's texts, one a turn, without any mark.

    Turns are sorted by number, then role, then text, so ties have one order; null numbers come first. Null text and
    null role are empty; a null conv_id is a conversation of its own; repeated rows are turns each; an empty table gives
    no rows; other columns are ignored. Turns are collected ``SEGMENT`` numbers at a time and put into messages there,
    so the task that ends a very long conversation reads one row a segment; its text is one value, as it is the result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    message = lambda t: F.struct(escape(t["role"]).alias("role"), F.array(escape(t["text"])).alias("texts"))
    rows = conversations.select("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment"), turn.alias("t"))
    parts = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = parts.select("conv_id", F.struct("segment", merged(F.transform("turns", message)).alias("messages")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.select("conv_id", merged(F.flatten(F.transform("parts", lambda p: p["messages"]))).alias("messages"))
    shown = lambda m: F.concat(F.lit(BEGIN + ROLE), m["role"], F.lit(BODY), F.array_join(m["texts"], NEXT), F.lit(END))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("messages", shown), "").alias("formatted"),
        mask_spans(F.col("messages")).alias("loss_spans"),
        F.size("messages").cast("long").alias("n_messages"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turns(message: Column) -> Column:
        texts = lambda h: F.split(h[1], r"\[TURN\]", -1)
        role = lambda h: unescape(F.substring(h[0], len(BEGIN + ROLE) + 1, 2**31 - 1))
        return bound(F.split(message, r"\[/ROLE\]", 2), lambda h: F.transform(texts(h), lambda x: F.struct(role(h).alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(F.filter(F.split(formatted, END, -1), lambda m: m != ""), turns))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before escaping, nothing between."""
    both = F.struct(formatted.cast("binary").alias("bytes"), spans.alias("spans"))
    cut = lambda b, s: unescape(F.substring(b, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")).cast("string"))
    return bound(both, lambda v: F.array_join(F.transform(v["spans"], lambda s: cut(v["bytes"], s)), ""))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What ``read_back`` and the loss mask give of formatted conversations, as counts and digests."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = chats.select("*", read_back(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts hold control strings of a template."""
    role = F.when(F.col("id") == 0, "user").otherwise(LEARNED)
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
