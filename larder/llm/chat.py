"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes one example: all turns before it as context, and
only its own text under the loss mask.  Turns after the last assistant turn
give one example without trainable text, so that no turn is lost.

A turn is written ``<s>[INST] role [/INST]text</s>``.  These four control
strings are escaped inside roles and texts (``&lt;`` and ``&lb;`` for their
first character, ``&amp;`` for an ampersand that would read as an escape), so
the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, HEAD, END = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    """Escape the template's control strings; ``unescape`` undoes it exactly."""
    out = F.regexp_replace(text, r"&(?=(?:amp|lt|lb);)", "&amp;")
    out = F.regexp_replace(out, r"<(?=/?s>)", "&lt;")
    return F.regexp_replace(out, r"\[(?=/?INST\])", "&lb;")


def unescape(text: Column) -> Column:
    """The text that ``escape`` got."""
    out = F.replace(text, F.lit("&lt;"), F.lit("<"))
    out = F.replace(out, F.lit("&lb;"), F.lit("["))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def format_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text", target: str = "assistant") -> DataFrame:
    """``id_col, example, n_context, formatted, loss_start, loss_length`` per target turn.

    ``formatted`` holds the context and the reply, ``loss_start`` (code points
    from 0) and ``loss_length`` the span of the reply's escaped text; the length
    is null in a closing example without a reply.  ``example`` counts from 0 in
    a conversation.  Rows are ordered by turn (null first), ties by role and
    text, and repeated rows stay.  A null role or text counts as empty; rows
    with a null id form one conversation.  One conversation must fit a row.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    conversations = turns.select(F.col(id_col).alias("__id"), row.alias("__row")) \
        .groupBy("__id").agg(F.sort_array(F.collect_list("__row")).alias("__turns"))
    body = F.transform("__turns", lambda t: F.struct(
        (t["role"] == target).alias("hit"),
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(HEAD)).alias("head"), escape(t["text"]).alias("text")))
    conversations = conversations.select("__id", F.explode(F.array(body)).alias("__body"))
    last = F.size("__body") - 1
    stops = F.filter(F.sequence(F.lit(0), last), lambda i: F.element_at("__body", i + 1)["hit"] | (i == last))
    whole = F.transform("__body", lambda t: F.concat(t["head"], t["text"], F.lit(END)))
    rows = conversations.withColumn("__whole", whole).withColumn("__stops", stops)
    rows = rows.select("__id", "__body", "__whole", F.posexplode("__stops").alias("example", "__k"))
    reply = F.element_at("__body", F.col("__k") + 1)
    rows = rows.select("__id", "example", F.col("__k").alias("n_context"), reply.alias("__reply"),
                       F.array_join(F.slice("__whole", 1, F.col("__k")), "").alias("__context"))
    return rows.select(
        F.col("__id").alias(id_col), "example", "n_context",
        F.concat("__context", "__reply.head", "__reply.text", F.lit(END)).alias("formatted"),
        (F.length("__context") + F.length("__reply.head")).cast("long").alias("loss_start"),
        F.when(F.col("__reply.hit"), F.length("__reply.text").cast("long")).alias("loss_length"))


def parse_turns(formatted: Column) -> Column:
    """The array of ``role, text`` that a formatted example was made from."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), HEAD, 1)).alias("role"),
        unescape(F.substring(p, F.locate(HEAD, p) + len(HEAD), F.length(p))).alias("text")))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped; empty where there is none."""
    return F.coalesce(unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int"))), F.lit(""))
