r"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it as context, its reply alone trainable. What follows the
last assistant turn (or all of a conversation without one) is kept as one more example with nothing trainable, so that the
output holds every turn. A turn is rendered as ``### role: text </turn>`` and a line feed. Inside roles and texts, characters
of the marks are escaped (``\`` as ``\\``, ``#`` as ``\h``, ``<`` as ``\l``, in roles ``:`` as ``\c``), so no text can hold a
mark, and unescaping gives the original back.

A conversation is one training context and has to fit in a row; conversations, not turns, are dealt over tasks.

Edge cases: null texts and roles count as empty; turns are ordered by turn, role and text (null turns first), repeated rows stay;
rows with a null conv_id form one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = " </turn>\n"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    r"""Escaped backslashes come in pairs that start at an escape, so splitting at the leftmost pairs finds them."""
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_chars: the trainable span of text in code points (0, 0: none)."""
    head = lambda role: F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))
    turns = (
        conversations.select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    rendered = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            F.concat(head(t["role"]), escape(t["text"]), F.lit(END)).alias("line"),
            F.length(head(t["role"])).alias("head"),
            F.length(escape(t["text"])).alias("body"),
            (t["role"] == TRAINABLE).alias("trainable"),
        )).alias("turns"),
    )
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["trainable"]) | (i == n))
    return (
        rendered.select("conv_id", "turns", F.posexplode(targets).alias("example", "upto"))
        .select(
            "conv_id", "example",
            F.array_join(F.transform(F.slice("turns", 1, F.col("upto")), lambda t: t["line"]), "").alias("text"),
            F.element_at("turns", F.col("upto")).alias("last"),
        )
        .select(
            "conv_id", "example", "text",
            F.when(F.col("last.trainable"), F.length("text") - F.col("last.body") - len(END)).otherwise(0).alias("loss_start"),
            F.when(F.col("last.trainable"), F.col("last.body")).otherwise(0).alias("loss_chars"),
        )
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted example, escapes undone."""
    lines = F.filter(F.split(text, r" </turn>\n"), lambda s: s != "")
    return F.transform(lines, lambda s: F.struct(
        unescape(F.substring(F.substring_index(s, ": ", 1), 5, 2147483647)).alias("role"),
        unescape(F.substr(s, F.length(F.substring_index(s, ": ", 1)) + 3)).alias("text"),
    ))


def digest_chats(examples: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its examples alone."""
    reply = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars")))
    per = examples.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"),
        F.when(F.col("loss_chars") > 0, reply).otherwise("").alias("reply"), "text",
    ).groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("replies"),
        F.max_by("text", "example").alias("whole"),
    )
    return per.withColumn("turns", read_turns(F.col("whole"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("replies").cast("long").alias("loss_chars"), F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars",
    )
