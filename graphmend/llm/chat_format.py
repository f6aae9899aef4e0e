"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; neighbours of
one role share a block, and the pieces are concatenated.  Every step is a
higher-order expression over the turn array with one result for each turn, so
the work is linear in the conversation's length.

A block is ``<|im_start|>role\\ntext<|im_end|>\\n``; further turns of the same
role follow after ``<|im_sep|>``.  In texts one backslash goes between ``<``
and ``|`` (after the backslashes already there), so no control string occurs
in them and unescaping is exact.  Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chats(turns: DataFrame, trained_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_mask)``, one row for each conversation.

    ``loss_mask`` covers ``formatted`` from its start: an array of structs
    ``(n_chars, loss)``, template and text in turn; the texts of
    ``trained_role`` have ``loss`` true.  Turns are ordered by turn, then role
    and text; repeated rows stay; null turns come first; a null role is the
    empty role, a null text the empty text; rows with a null conversation form
    one conversation of their own.  Other columns are not read.  An empty
    table gives an empty result.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def piece(t, i):
        before = F.get(F.col("ts"), i - 1)
        head = F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
        lead = F.when(i == 0, head).when(before["role"] == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), head))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("loss"))

    pieces = sorted_turns.select("conv_id", F.transform("ts", piece).alias("ps"))
    formatted = F.concat(F.array_join(F.flatten(F.transform("ps", lambda p: F.array(p["lead"], p["text"]))), ""), F.lit(END))
    runs = F.flatten(F.transform("ps", lambda p: F.array(
        F.struct(F.length(p["lead"]).cast("long").alias("n_chars"), F.lit(False).alias("loss")),
        F.struct(F.length(p["text"]).cast("long").alias("n_chars"), p["loss"].alias("loss")))))
    last = F.array(F.struct(F.lit(len(END)).cast("long").alias("n_chars"), F.lit(False).alias("loss")))
    return pieces.select("conv_id", formatted.alias("formatted"), F.concat(runs, last).alias("loss_mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted)`` read back from ``formatted`` and ``loss_mask``.

    ``turns`` are structs ``(role, text)``, unescaped; ``loss_text`` is the
    unescaped text under the mask, run after run.  A mask with a run, template
    or text, of another length than what it lies on, or with a template run
    under the loss, is an error: so every run begins where its text does.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns_of(block, k):
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.regexp_extract(body, r"^([^\n]*)\n", 1)
        head = F.length(role) + len(START) + 1 + F.when(k > 0, len(END)).otherwise(0)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t, i: F.struct(
            F.url_decode(role).alias("role"), t.alias("text"), F.when(i == 0, head).otherwise(len(SEP)).cast("long").alias("lead")))

    raw = chats.select("conv_id", "formatted", "loss_mask", F.flatten(F.transform(blocks, turns_of)).alias("raw"))
    lengths = F.concat(F.flatten(F.transform("raw", lambda t: F.array(t["lead"], F.length(t["text"]).cast("long")))),
                       F.array(F.lit(len(END)).cast("long")))
    template = F.filter("loss_mask", lambda x, i: i % 2 == 0)
    fits = (F.transform("loss_mask", lambda x: x["n_chars"]) == lengths) & ~F.exists(template, lambda x: x["loss"])
    of_texts = F.filter("loss_mask", lambda x, i: i % 2 == 1)
    under = F.zip_with("raw", of_texts, lambda t, m: F.when(m["loss"], unescape(t["text"])).otherwise(F.lit("")))
    loss_text = F.when(F.coalesce(fits, F.lit(False)), F.array_join(under, "")).otherwise(
        F.raise_error(F.lit("loss mask does not fit the text")).cast("string"))
    return raw.select("conv_id", F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
                      loss_text.alias("loss_text"), "formatted")


def chat_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_chats`` gives."""
    back = read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
