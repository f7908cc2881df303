"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it as context, and
only its own text trainable.  Turns after the last assistant turn (or a
conversation without one) get one example with nothing trainable, so no turn is
lost.

    <|im_start|>role
    text<|im_end|>

Control strings inside texts are escaped with a backslash, backslashes doubled;
:func:`parse` reverses it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """No ``<|`` is left, and every backslash starts a pair."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and a line break cannot end the role early."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    """Line breaks first: an ``n`` after an odd number of backslashes is one."""
    breaks = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(breaks)


def examples(conversations: DataFrame) -> DataFrame:
    """The training examples of (conv_id, turn, role, text).

    Columns: conv_id, example (1, 2, … in each conversation), n_turns (in the
    example), text, loss_start and loss_end (code points of ``text``, end
    exclusive, null where nothing is trainable).

    Null roles and texts are empty.  Turns are ordered by turn (null first),
    then role and text; repeated rows are turns of their own.  A null conv_id
    is a conversation; an empty table gives an empty one.  Other columns are not read.  The last example of a
    conversation is one row holding all of it, so a conversation is gathered
    into one row, and each example then made from that by itself.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))
    whole = whole.withColumns({
        "blocks": F.transform("turns", lambda t: F.concat(
            F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["body"]), F.lit(END + "\n"))),
        "targets": F.filter(
            F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)), lambda i: i.isNotNull()),
    })
    n = F.size("turns")
    ends = F.when(
        F.coalesce(F.try_element_at("targets", F.lit(-1)), F.lit(0)) < n, F.concat("targets", F.array(n))
    ).otherwise(F.col("targets"))
    each = whole.select("conv_id", "turns", "blocks", F.posexplode(ends).alias("place", "last"))
    text = F.array_join(F.slice("blocks", F.lit(1), F.col("last")), "")
    target = F.element_at("turns", F.col("last"))
    each = each.select(
        "conv_id", (F.col("place") + 1).alias("example"), F.col("last").cast("long").alias("n_turns"),
        text.alias("text"), (target["role"] == TRAINED).alias("trained"),
        F.length(escape(target["body"])).alias("size"))
    loss_end = F.length("text") - len(END + "\n")
    return each.select(
        "conv_id", "example", "n_turns", "text",
        F.when(F.col("trained"), loss_end - F.col("size")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), loss_end).cast("long").alias("loss_end"))


def parse(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    blocks = F.slice(F.split(text, r"<\|im_end\|>\n", -1), F.lit(1), F.size(F.split(text, r"<\|im_end\|>\n", -1)) - 1)

    def turn(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(START) + 1))
        line = F.locate("\n", inner) if isinstance(inner, str) else F.instr(inner, "\n")
        return F.struct(
            unescape_role(F.substr(inner, F.lit(1), line - 1)).alias("role"),
            unescape(F.substr(inner, line + 1)).alias("text"))

    return F.transform(blocks, turn)


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation, read from its examples alone.

    The longest example gives the turns; what the loss masks cover, in order,
    gives the trained text.  ``formatted_chars`` counts all examples.
    """
    loss = F.when(F.col("loss_start").isNotNull(), unescape(
        F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    seen = made.select("conv_id", "example", "n_turns", "text", loss.alias("loss"))
    # Only the longest example is needed whole; the others give their reply.
    whole = seen.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
        F.count("loss").alias("n_examples"))
    turns = whole.withColumns({
        "turns": parse(F.col("longest")),
        "trained": F.array_join(F.transform("losses", lambda x: x["loss"]), ""),
    })
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples")
