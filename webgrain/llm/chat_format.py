r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its
context, and its reply alone is trainable. Turns after the last assistant turn
are kept in one more row that trains nothing, so no turn is lost.

Template, for each turn::

    ### role: text </turn>\n

In texts, the characters \ # < get a backslash before them, in roles also the
colon. So neither "###" nor "</turn>" can occur inside a text, and dropping each
backslash that is not itself escaped gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = " </turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#<]", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\#<:]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row for each trained turn, and one for what follows the last of them.

    Returns conv_col, example (0, 1, ... in a conversation), n_turns (turns in
    this row), formatted, loss_start and loss_end (code points in formatted; the
    text of the reply lies between; both null in a row without a reply).

    Turns are put in order by turn, role and text, nulls first, so ties and
    repeated rows have a fixed order and all of them stay. A null role or text is
    an empty one. Rows with a null conv_col belong to no conversation and are
    left out. Other columns are ignored. No rows give no rows.

    A conversation is one row of the result by its nature, so it is gathered by
    its id; its size is that of one training example. There is one shuffle.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    head = F.concat(F.lit("### "), escape_role(role), F.lit(": "))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("text"),
            head.alias("head"),
            escape(text).alias("body"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("ts", i)["role"] == trained_role)
    tail = F.when(F.get("ts", last)["role"] != trained_role, F.array(last)).otherwise(F.array().cast("array<int>"))
    examples = talks.select("conv", "ts", F.posexplode(F.concat(targets, tail)).alias("example", "at"))
    one = lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))
    whole = F.array_join(F.transform(F.slice("ts", 1, F.col("at") + 1), one), "")
    reply = F.get("ts", "at")
    trained, end = F.col("reply.role") == trained_role, F.length("formatted") - len(TURN_END)
    return examples.select("conv", "example", "at", whole.alias("formatted"), reply.alias("reply")).select(
        F.col("conv").alias(conv_col),
        "example",
        (F.col("at") + 1).cast("long").alias("n_turns"),
        "formatted",
        F.when(trained, end - F.length("reply.body")).cast("long").alias("loss_start"),
        F.when(trained, end).cast("long").alias("loss_end"),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of a row, unescaped (null where nothing is trained)."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted row: what went into it."""
    parts = F.filter(F.split(formatted, TURN_END), lambda p: p != "")
    role = lambda p: F.regexp_extract(p, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(role(p)).alias("role"),
            unescape(F.substring(p, F.length(role(p)) + 7, F.length(p))).alias("text"),
        ),
    )
