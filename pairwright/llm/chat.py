"""Chat formatting: prefix-target expansion (DataFrame functions only).

Each assistant turn becomes an example of its own: every preceding turn is context, and only that
reply lies under the loss mask. The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.

Escaping is reversible. In texts and roles ``\\`` becomes ``\\\\`` and then ``<|`` becomes ``<\\|``,
so no text can hold a control string; a line break in a role becomes the control string ``<|nl|>``.

Defined cases: a null role or text is empty; turns run by (turn, role, text) with null turns first,
so ties and repeated rows have one order and each row is a turn; rows of a null conv_id form one
conversation; a conversation that doesn't end in an assistant turn has one more example with an
empty mask (``target`` null), so that no turn is lost; an empty table gives no example. Columns
other than conv_id, turn, role and text are ignored.

A conversation is one row while it is formatted, since its digest and its prefixes need it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<|nl|>"), F.lit("\n")))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, target (index of the trainable turn, null for none), text, loss_start, loss_end (code points)."""
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == "assistant").alias("is_target"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("lens"),
        F.transform(
            "turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
        ).alias("parts"),
    )
    n = F.size("parts")
    picked = F.filter(
        F.sequence(F.lit(1), n), lambda i: F.element_at("is_target", i) | (i == n)
    )
    each = whole.select("*", F.explode(picked).alias("i"))
    each = each.select(
        "conv_id",
        F.when(F.element_at("is_target", F.col("i")), F.col("i") - 1).alias("target"),
        F.array_join(F.slice("parts", F.lit(1), F.col("i")), "").alias("text"),
        F.element_at("lens", F.col("i")).alias("n"),
    )
    end = F.length("text") - len(END)
    return each.select(
        "conv_id", "target", "text",
        F.when(F.col("target").isNotNull(), end - F.col("n")).otherwise(end).alias("loss_start"), end.alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, 2_000_000_000)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted examples: counts and digests of turns and of what the masks cover."""
    under = F.expr("substring(text, loss_start + 1, loss_end - loss_start)")
    rows = examples.select("conv_id", "target", "text", F.length("text").alias("n"), F.when(F.col("target").isNotNull(), unescape(under)).alias("loss"))
    per = rows.groupBy("conv_id").agg(
        F.max_by("text", "n").alias("text"),
        F.sum("n").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))).alias("losses"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    per = per.select("conv_id", "formatted_chars", loss.alias("loss"), read_back(F.col("text")).alias("turns"))
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
