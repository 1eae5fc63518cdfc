r"""Chat formatting from event logs, in DataFrame functions alone.

A log holds events of conversations: ``message`` starts a turn's text anew,
``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it and
drops every later turn logged so far.  The log is partitioned by conversation,
ordered by sequence, folded into final messages, and rendered.

A rendered turn is ``### role: text</turn>\n``.  Inside texts a backslash, a
``#`` and the ``/`` of ``</`` carry a backslash before them, so neither mark
can occur in a text; roles are URL-encoded.  Both are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

END = "</turn>\n"
RESETS = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\\#]", r"\\$0")
    return F.replace(text, F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Of a turn's events those from its last message, edit or regenerate on
    count, in order of seq; events of a turn that a later regenerate of an
    earlier turn came after are dropped.  An unknown kind counts as a delta.
    Null seq and null turn sort before all others, a null text adds nothing,
    the last role that is not null holds.  Equal seqs are ordered by kind and
    text.  A turn of which nothing is left is no message.
    """
    log = pick(events, "conv_id", "seq", "turn", "kind", "role", "text")
    place = F.struct("seq", "kind", "text")
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    cut_at = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    live = log.withColumn("cut_at", cut_at).where("cut_at IS NULL OR seq > cut_at")
    later = Window.partitionBy("conv_id", "turn").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    resets = F.count(F.when(F.col("kind").isin(*RESETS), 1)).over(later)
    live = live.withColumn("resets", resets).where("resets = 0")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    return live.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind"))).alias("role"),
        F.concat_ws("", F.transform(pieces, lambda x: x["text"])).alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns: the text of a conversation and where its turns and losses lie.

    turns is an array of (start, length, loss_start, loss_length) in code
    points of ``formatted``, in order of turn; loss_length is 0 but for the
    texts (escaped, without marks) of ``loss_role``.  Repeated turns are
    rendered in order of role and text; null roles and texts count as empty.
    """
    rows = pick(messages, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.withColumns({"head": F.concat(F.lit("### "), F.url_encode("role"), F.lit(": ")), "body": escaped(F.col("text"))})
    rows = rows.withColumn("shown", F.concat("head", "body", F.lit(END)))
    rows = rows.withColumns({"length": F.length("shown").cast("long"), "body_length": F.length("body").cast("long")})
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({
        "at": F.row_number().over(in_order),
        "end": F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    spans = F.struct(
        (F.col("end") - F.col("length")).alias("start"),
        "length",
        (F.col("end") - F.col("length") + F.length("head")).alias("loss_start"),
        F.when(F.col("role") == loss_role, F.col("body_length")).otherwise(F.lit(0).cast("long")).alias("loss_length"),
    )
    both = F.array_sort(F.collect_list(F.struct("at", "shown", spans.alias("span"))))
    grouped = rows.groupBy("conv_id").agg(both.alias("both"))
    return grouped.select(
        "conv_id",
        F.concat_ws("", F.transform("both", lambda x: x["shown"])).alias("formatted"),
        F.transform("both", lambda x: x["span"]).alias("turns"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """What ``render`` wrote, read back: conv_id, messages (role, text), loss_texts, formatted_chars."""
    shown = F.split("formatted", END, -1)
    shown = F.slice(shown, F.lit(1), F.size(shown) - 1)
    pieces = rendered.select("conv_id", "turns", shown.alias("shown"), F.length("formatted").cast("long").alias("formatted_chars"))
    colon = lambda x: F.locate(": ", x)  # noqa: E731  the first one ends the role, which holds no colon

    def message(x: Column) -> Column:
        return F.struct(
            F.url_decode(x.substr(F.lit(5), colon(x) - 5)).alias("role"),
            unescaped(x.substr(colon(x) + 2, F.length(x))).alias("text"),
        )

    losses = F.zip_with("shown", F.filter("turns", lambda t: t["length"] > 0), lambda x, t: F.when(t["loss_length"] > 0, unescaped(x.substr((t["loss_start"] - t["start"] + 1).cast("int"), t["loss_length"].cast("int")))))
    return pieces.select(
        "conv_id",
        F.transform("shown", message).alias("messages"),
        F.filter(losses, lambda x: x.isNotNull()).alias("loss_texts"),
        "formatted_chars",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Render a plain table of turns (conv_id, turn, role, text) through the event log.

    Each row is one ``message`` event; its place in its conversation, by turn,
    then role and text, is both its sequence and its turn, so rows that share a
    turn number stay turns of their own.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    at = F.row_number().over(in_order).cast("long")
    events = rows.select("conv_id", at.alias("seq"), at.alias("turn"), F.lit("message").alias("kind"), "role", "text")
    return render(fold(events))
