"""Chat formatting in Spark expressions only: turns to one training text with a loss mask, and back.

Turn structs of a conversation are collected and sorted, adjacent turns of a role become one block, and blocks are
joined to a text:

    <|turn|>role<|text|>first text<|next|>second text of the same role<|end|>

Control strings inside roles and texts are escaped with backslashes, so the text can be read back exactly.
A conversation is one row of the result, so it has to fit into one value, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Strings that mark turns here or in other templates, with what stands for each inside a text.
ESCAPES = (
    ("\\", "\\\\"),
    ("<|", "<\\|"),
    ("|>", "|\\>"),
    ("<s>", "<\\s>"),
    ("</s>", "<\\/s>"),
    ("[INST]", "[\\INST]"),
    ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<\\<SYS>>"),
    ("<</SYS>>", "<\\</SYS>>"),
)


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """A backslash stands before the character it protects, whatever that is."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``formatted``.

    Turns stand by turn number, then role, then text; a missing number comes first. Null roles and texts are empty ones.
    Repeated rows are turns of their own. Rows without a conversation id make one conversation together. Other columns
    are not read. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    firsts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    merged = ordered.withColumn("firsts", firsts).withColumn(
        "blocks",
        F.transform(
            "firsts",
            lambda first, k: F.struct(
                F.get("turns", first)["role"].alias("role"),
                F.slice("turns", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("turns")) - first).getField("text").alias("texts"),
            ),
        ),
    )
    block = lambda b: F.concat(
        F.lit(TURN), escaped(b["role"]), F.lit(TEXT), F.array_join(F.transform(b["texts"], escaped), NEXT), F.lit(END)
    )
    return merged.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"))


def read_back(chats: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """``chats`` with ``turns`` and ``segments``, both read from ``formatted``.

    ``turns`` are the structs (role, text) that went in. ``segments`` cut the formatted text, in order and without gaps,
    into structs (piece, in_loss): pieces under the loss mask are the still escaped texts of ``learn_role``.
    """
    blocks = F.transform(
        F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda b: b != ""),
        lambda b: F.struct(
            F.regexp_extract(b, r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1).alias("role"),
            F.split(F.regexp_replace(b, r"(?s)^<\|turn\|>.*?<\|text\|>", ""), r"<\|next\|>", -1).alias("texts"),
        ),
    )
    read = chats.withColumn("_blocks", blocks)
    turns = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.transform(
                b["texts"], lambda t: F.struct(unescaped(b["role"]).alias("role"), unescaped(t).alias("text"))
            ),
        )
    )
    piece = lambda text, learnt: F.struct(text.alias("piece"), learnt.alias("in_loss"))
    segments = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.flatten(
                F.transform(
                    b["texts"],
                    lambda t, i: F.array(
                        piece(F.when(i == 0, F.concat(F.lit(TURN), b["role"], F.lit(TEXT))).otherwise(NEXT), F.lit(False)),
                        piece(t, unescaped(b["role"]) == learn_role),
                        piece(F.when(i == F.size(b["texts"]) - 1, F.lit(END)).otherwise(""), F.lit(False)),
                    ),
                )
            ),
        )
    )
    return read.withColumn("turns", turns).withColumn("segments", segments).drop("_blocks")
