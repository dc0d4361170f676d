"""Chat formatting of message threads: quotes are linked to what they quote, then left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskmill.llm.common import let
from taskmill.scale import stage

# A row of chat holds so many messages of a conversation at most.
SEGMENT = 1024
# A passage is linked to a message that has at least this share of its characters.
LEAST_SHARE = 1 / 3
MARKERS = r"^(?:[ \t]*>)+[ \t]?"
# A line that announces a quote right below it, as mail programs write it (fixed values).
ANNOUNCES = r"(?i)(?:\bwrote|\bschrieb|\ba écrit|\bescribió)\s*:\s*$"
HEADER, END_OF_TURN = "<|{role}|>\n", "\n<|end|>\n"


def quote_lines(text: Column) -> Column:
    """The lines of a text as (level, body): how often ``>`` stands before it, and what follows."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.transform(F.split(plain, "\n"), lambda line: F.struct(
        (F.length(F.regexp_extract(line, MARKERS, 0)) - F.length(F.replace(F.regexp_extract(line, MARKERS, 0), F.lit(">"), F.lit(""))))
        .alias("level"),
        F.regexp_replace(line, MARKERS, "").alias("body"),
    ))


def _runs(lines: Column) -> Column:
    """Neighbouring lines of one level as (level, lines)."""
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (
        F.get(lines, i)["level"] != F.coalesce(F.get(lines, i - 1)["level"], F.lit(-1))
    ))
    return let(places, lambda starts: F.transform(starts, lambda s, j: F.struct(
        F.get(lines, s)["level"].alias("level"),
        F.transform(
            F.slice(lines, s + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - s), lambda x: x["body"]
        ).alias("lines"),
    )))


def _own_text(lines: Column) -> Column:
    """The unquoted lines without announcements of quotes, blank lines around them taken off."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        x["body"].rlike(ANNOUNCES) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
    ))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """What two passages are compared by: lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passage_hashes(text: Column) -> Column:
    """Hashes of what others may quote of a text: all of it, its paragraphs and its lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_distinct(F.transform(
        F.filter(F.transform(parts, normalised), lambda x: x != ""), lambda x: F.md5(x)
    ))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Add ``content``, the text without quotes, and ``quotes``: (level, chars, parts) per quoted passage.

    Its parts are the whole and each of its lines, by hash and length; ``chars`` is the length of all lines.
    """
    def said(lines: Column) -> Column:
        return F.filter(F.transform(lines, normalised), lambda x: x != "")

    def parts(lines: Column) -> Column:
        each = F.concat(F.array(normalised(F.array_join(lines, "\n"))), said(lines))
        return F.array_distinct(F.transform(each, lambda x: F.struct(F.md5(x).alias("hash"), F.char_length(x).alias("chars"))))

    def chars(lines: Column) -> Column:
        return F.aggregate(said(lines), F.lit(0), lambda n, x: n + F.char_length(x))

    parsed = let(quote_lines(F.col("text")), lambda lines: F.struct(
        _own_text(lines).alias("content"),
        F.transform(
            F.filter(_runs(lines), lambda r: (r["level"] > 0) & F.exists(r["lines"], lambda x: F.trim(x) != "")),
            lambda r: F.struct(
                r["level"].alias("level"), chars(r["lines"]).alias("chars"), parts(r["lines"]).alias("parts")
            ),
        ).alias("quotes"),
    ))
    return messages.withColumn("__parsed", parsed).select(
        *[c for c in messages.columns if c not in ("content", "quotes")], "__parsed.content", "__parsed.quotes"
    )


def link_quotes(parsed: DataFrame) -> DataFrame:
    """Per message that quotes: (conv_id, turn, passage, level, origin), origin null where nothing is found.

    Every part of a passage, the whole and its lines, names the nearest earlier message of the conversation
    that has it unquoted. The passage is linked to the message named for the largest share of its
    characters, the nearest of several, if that is ``LEAST_SHARE`` or more. A part names one message
    at most, so a line that everybody writes makes no pairs.
    """
    key = ["conv_id", "hash"]
    quoting = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("passage", "q"))
    passages = quoting.select("conv_id", "turn", "passage", F.col("q.level").alias("level"), F.col("q.chars").alias("chars"))
    parts = stage(quoting.select("conv_id", "turn", "passage", F.explode("q.parts").alias("p")).select(
        "conv_id", "turn", "passage", F.col("p.hash").alias("hash"), F.col("p.chars").alias("part")
    ), "parts")
    talking = parts.select("conv_id").distinct()
    holders = parsed.join(talking, "conv_id", "left_semi").select(
        "conv_id", "turn", F.explode(_passage_hashes(F.col("content"))).alias("hash")
    ).join(parts.select(*key).distinct(), key, "left_semi")
    # In the order of the turns; a message does not quote itself, so holders of a turn come after its quotes.
    both = parts.withColumn("holds", F.lit(False)).unionByName(holders.withColumn("holds", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy("turn", "holds").rowsBetween(Window.unboundedPreceding, -1)
    named = both.withColumn("origin", F.last(F.when(F.col("holds"), F.col("turn")), ignorenulls=True).over(before))
    shares = named.where(~F.col("holds") & F.col("origin").isNotNull()).groupBy("conv_id", "turn", "passage", "origin").agg(
        F.sum("part").alias("share")
    ).groupBy("conv_id", "turn", "passage").agg(F.max(F.struct("share", "origin")).alias("best"))
    of_passage = ["conv_id", "turn", "passage"]
    return passages.join(shares, of_passage, "left").select(
        *of_passage, "level", F.when(F.col("best.share") >= LEAST_SHARE * F.col("chars"), F.col("best.origin")).alias("origin")
    )


def reply_links(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, n_quotes, n_linked) of the messages that quote.

    A message replies to the origin of its first linked passage of the lowest level; its thread is where
    the chain of replies ends, found by doubling the steps.
    """
    first = F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "passage", "origin")))
    each = stage(links.groupBy("conv_id", "turn").agg(
        first["origin"].alias("reply_to"), F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked")
    ), "replies")
    up = each.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("__above"))
        raised = stage(up.join(above, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("__above", "thread").alias("thread"), F.col("__above").isNotNull().alias("__up")
        ), "threads")
        up = raised.drop("__up")
        if raised.where("__up").isEmpty():
            return each.join(up, ["conv_id", "turn"], "left")


def format_chats(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation and segment: its messages in reply order without quotes, and the chat text.

    Columns: ``conv_id, segment, n_messages, n_quotes, n_linked``, ``messages`` (thread, turn, reply_to,
    role, content) and ``chat``. A message stands after the one it replies to, threads in the order of their
    first turn. A conversation of at most ``SEGMENT`` messages is one row, whatever its turns are numbered; of
    a longer one each ``SEGMENT`` messages in this order are a row, so that no row grows without bound and
    replies still follow. A very long message is part of one row, whole.

    Repeated rows count once. Messages with a null conversation or turn are left out, a null role is
    ``user``, a null text is empty. A message of quotes only has an empty content and stays. Other columns
    are not read; an empty table gives an empty result.
    """
    rows = messages.where(F.col(conv_id).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    parsed = stage(parse_quotes(rows).drop("text"), "messages")
    replies = reply_links(link_quotes(parsed))
    zero = F.lit(0).cast("long")
    placed = parsed.select("conv_id", "turn", "role", "content").join(replies, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "content", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
    )
    order = Window.partitionBy("conv_id").orderBy("thread", "turn", "role", "content")
    placed = placed.withColumn("segment", F.floor((F.row_number().over(order) - 1) / SEGMENT))
    header = F.replace(F.lit(HEADER), F.lit("{role}"), F.col("role"))
    grouped = placed.withColumn("__said", F.concat(header, "content", F.lit(END_OF_TURN))).groupBy(
        "conv_id", "segment"
    ).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("thread", "turn", "role", "content", "reply_to", "__said"))).alias("m"),
    )
    return grouped.select(
        F.col("conv_id").alias(conv_id), "segment", "n_messages", "n_quotes", "n_linked",
        F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in ("thread", "turn", "reply_to", "role", "content")]))
        .alias("messages"),
        F.array_join(F.transform("m", lambda x: x["__said"]), "").alias("chat"),
    )
