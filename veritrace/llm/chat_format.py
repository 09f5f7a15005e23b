"""Chat formatting with Spark expressions only.

A conversation is `<s>[role]text[+]text</s>` for each run of adjacent turns of one role. Inside
roles and texts a backslash, `<`, `[` and `]` are written as a backslash and 0, 1, 2 and 3: so no
control string can occur there, and the output can be read back exactly. Turns are collected as
structs and sorted; runs of one role are slices of that array; all steps are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, cut, let, starts

_CODES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3")]


def escape(c: Column) -> Column:
    for plain, coded in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(_CODES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role: array<array<turn>>."""
    place = F.sequence(F.lit(0), F.size(turns) - 1)
    heads = F.filter(place, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(heads, lambda h: F.transform(h, lambda a, k: F.slice(turns, a + 1, F.coalesce(F.get(h, k + 1), F.size(turns)) - a)))


def _pieces(run: Column, learn: str) -> Column:
    """What a run is written as: array<struct<s, loss>>."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    role, none = F.get(run, F.lit(0))["role"], F.lit(False)
    texts = F.transform(run, lambda t, i: F.array(piece(F.when(i > 0, F.lit("[+]")).otherwise(F.lit("")), none), piece(escape(t["text"]), t["role"] == learn)))
    return F.concat(F.array(piece(F.concat(F.lit("<s>["), escape(role), F.lit("]")), none)), F.flatten(texts), F.array(piece(F.lit("</s>"), none)))


def format_chats(turns: DataFrame, id_col: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """turns: (id, turn, role, text). One row per conversation: (id, formatted, loss_spans).

    Turns go by turn, then role, then text, so that ties and repeated rows have one order; a null
    turn comes first. Repeated rows are turns of their own. A null text or role is empty; rows without
    an id make one conversation. loss_spans are the code-point ranges (end exclusive) of the texts of
    the role `learn`, one per turn. Very long texts are kept whole. An empty table gives no rows;
    further columns, whatever their names, are ignored. A conversation is one row of the result, so
    its turns are collected: the largest conversation bounds a task's memory.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    out = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = out.withColumn("pieces", F.flatten(F.transform(_runs(F.col("turns")), lambda r: _pieces(r, learn))))
    begin = starts(F.transform("pieces", lambda p: F.length(p["s"])))
    spans = F.zip_with("pieces", begin, lambda p, at: F.struct(at.alias("start"), (at + F.length(p["s"])).alias("end"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return out.select(F.col("id").alias(id_col), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, "</s>", -1), lambda b: b != "")

    def of(b: Column) -> Column:
        role = F.regexp_extract(b, r"^<s>\[([^\]]*)\]", 1)
        body = F.substr(b, F.length(role) + 6)
        return F.transform(F.split(body, r"\[\+\]", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(blocks(formatted), lambda held: F.array_join(F.transform(spans, lambda s: unescape(cut(held, s["start"], s["end"] - s["start"]))), ""))
