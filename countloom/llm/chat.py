"""Chat formatting with a grammar round trip, with DataFrame operations only.

Grammar: conversation = { "<|im_start|>" role "\\n" text "<|im_end|>\\n" }. In texts and roles every "<"
that is followed by any number k of backslashes and "|" may be written with k + 1 backslashes; the
reader takes one backslash away wherever k >= 1. Escaped content so never holds "<|", and reading undoes
writing for every string. Roles also write backslash and newline as two characters.

A conversation is first rendered raw, read back and compared with its source; where they differ its
content is escaped and it is compared again, so only conflicting conversations change. What still
differed would raise.

Nulls and odd rows: null text and null role are empty; null turns sort first; equal turns sort by role
and text; a null conv_id is a conversation of its own; other columns are ignored. A conversation is one row and
one string, so its turns meet in one task; the place of each turn is a running sum over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _role_out(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(c: Column) -> Column:
    lines = F.regexp_replace(unescape(c), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    """The pieces of the formatted string, one for each turn: head, body and tail."""
    role = (lambda c: _role_out(c)) if escaped else (lambda c: c)
    body = (lambda c: escape(c)) if escaped else (lambda c: c)
    return F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), role(t["role"]), F.lit("\n")).alias("head"), body(t["text"]).alias("body")))


def joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) read from a formatted string: split at the start mark, then at the first newline, without the end mark."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    cut = lambda p: F.instr(p, "\n")
    tail = len(END)
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_in(F.substring(p, F.lit(1), cut(p) - 1)).alias("role"),
            unescape(F.substring(p, cut(p) + 1, F.greatest(F.lit(0), F.length(p) - cut(p) - tail))).alias("text"),
            p.endswith(END).alias("closed"),
        ),
    )


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, escaped (whether it had to be), spans (start and length, in characters of formatted, of the text under the loss mask), turns as read back.

    turns has conv_id, turn, role, text."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", clean("role").alias("role"), clean("text").alias("text"))
    order, places = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0), []
    for kind, role, text in (("plain", F.col("role"), F.col("text")), ("marked", _role_out(F.col("role")), escape(F.col("text")))):
        head, body = F.length(role) + len(START) + 1, F.length(text)  # of each turn as it stands in either form of the conversation
        at = F.sum(head + body + len(END)).over(order) - body - len(END)
        places.append(F.struct(at.cast("int").alias("start"), body.alias("length")).alias(kind))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", *places).alias("one"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("k"))
    conv = conv.withColumn("source", F.transform("k", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    back = lambda c: F.transform(parse(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    closed = lambda c: F.forall(parse(c), lambda t: t["closed"])
    conv = conv.withColumn("raw", joined(render(F.col("source"), False)))
    conv = conv.withColumn("escaped", ~((back(F.col("raw")) == F.col("source")) & closed(F.col("raw"))))
    conv = conv.withColumn("pieces", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(render(F.col("source"), False)))
    conv = conv.withColumn("formatted", F.when(F.col("escaped"), joined(F.col("pieces"))).otherwise(F.col("raw"))).drop("raw")
    conv = conv.withColumn("turns", back(F.col("formatted")))
    ok = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not survive the round trip")).cast(conv.schema["turns"].dataType))
    conv = conv.withColumn("turns", ok)
    learnt = F.filter("k", lambda t: t["role"] == learn_role)
    conv = conv.withColumn("spans", F.transform(learnt, lambda t: F.when(F.col("escaped"), t["marked"]).otherwise(t["plain"])))
    return conv.select("conv_id", "formatted", "escaped", "spans", "turns")


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read from the formatted string and unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
