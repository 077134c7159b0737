"""Chat formatting with relational expressions: sorted turns, merged roles, reversible escapes, loss mask.

A conversation is one row of the result, so its turns are collected; sorting, merging and reading back are array
expressions. Template: ``<s>role`` line end, texts of adjacent turns of that role with ``<sep>`` between, ``</s>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import running_totals

# The template's marks, control strings that texts must not contain, and their escapes.
BEGIN, END, SEPARATOR = "<s>", "</s>", "<sep>"
ESCAPES = [("~", "~0"), ("<s>", "~1s>"), ("</s>", "~1/s>"), ("<sep>", "~1sep>"), ("[INST]", "~2INST]"), ("[/INST]", "~2/INST]")]
UNESCAPES = [("~1", "<"), ("~2", "["), ("~0", "~")]
TRAINED = "assistant"


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    """The text without control strings; every escape starts with a tilde, and tildes are escaped first."""
    return _replaced(text, ESCAPES)


def unescaped(text: Column) -> Column:
    return _replaced(text, UNESCAPES)


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, loss): the text of each conversation and its spans [start, end) under the loss mask.

    Turns are sorted by (turn, role, text), nulls first; null roles and texts are empty. Adjacent turns of one role
    share a block. Spans are code points, one for each non-empty text of the trained role. Rows without conv_id form one
    conversation. Repeated rows are turns of their own. Other columns do not take part.
    """
    line = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sorted_turns = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), line.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t, k):
        before = F.get("turns", k - 1)["role"]
        head = F.concat(F.lit(BEGIN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("~3")), F.lit("\n"))
        mark = F.when(k == 0, head).when(before == t["role"], F.lit(SEPARATOR)).otherwise(F.concat(F.lit(END), head))
        return F.struct(mark.alias("mark"), escaped(t["text"]).alias("text"), (t["role"] == trained).alias("trained"))

    parts = sorted_turns.select("conv_id", F.transform("turns", pieces).alias("parts"))
    parts = parts.withColumn("ends", running_totals(F.transform("parts", lambda p: F.length(p["mark"]) + F.length(p["text"]))))
    spans = F.transform("parts", lambda p, k: F.struct((F.get("ends", k) - F.length(p["text"])).alias("start"), F.get("ends", k).alias("end"), p["trained"].alias("on")))
    loss = F.transform(F.filter(spans, lambda s: s["on"] & (s["start"] < s["end"])), lambda s: F.struct(s["start"], s["end"]))
    body = F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["text"])), "")
    return parts.select("conv_id", F.concat(body, F.lit(END)).alias("formatted"), loss.alias("loss"))


def turns_of(text: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(text, END), lambda b: b != "")

    def read(block):
        role = F.substring_index(block, "\n", 1)
        rest = F.substr(block, F.length(role) + 2)
        name = unescaped(F.replace(F.replace(role, F.lit(BEGIN), F.lit("")), F.lit("~3"), F.lit("\n")))
        return F.transform(F.split(rest, SEPARATOR, -1), lambda t: F.struct(name.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_texts(text: Column, loss: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"])))
