"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens the
parts in order into one string: text is escaped, every other part becomes a placeholder
with a running number, and its reference and expanded token count are recorded. Turns are
joined by a template of control strings, and the loss mask marks the assistant's text.

Escaping: in roles and in runs of neighbouring text parts, joined first, ``<``, any number of backslashes, then ``|`` gets one more
backslash; reading back takes one away. So ``<|`` never occurs in an escaped text, and every
control string in the output is the template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))).cast(PART_TYPE)


def _tokens(part: Column, patch: int, audio_rate: int, page_tokens: int) -> Column:
    """Expanded token count of a part: image patches, audio frames, document pages; none of a text."""
    def at_least_one(x: Column) -> Column:
        return F.greatest(F.coalesce(x.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    return (F.when(part["type"] == "image", at_least_one(F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)))
            .when(part["type"] == "audio", at_least_one(F.ceil(part["seconds"] * audio_rate)))
            .when(part["type"] == "document", at_least_one(part["pages"] * page_tokens))
            .otherwise(F.lit(0).cast("long")))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str | None = "text", parts_col: str | None = None, patch: int = 28,
                         audio_rate: int = 25, page_tokens: int = 256) -> DataFrame:
    """One row per conversation: (conv, formatted, loss_spans, attachments, attachment_tokens, n_turns).

    ``parts_col`` (of ``PART_TYPE``) or ``text_col`` gives the content. ``loss_spans`` are
    (begin, end) code points of the assistant's texts in ``formatted``; ``attachments`` are
    (turn number, number in the turn, type, ref, tokens) in order. Null role or text is
    empty; a null part or one of an unknown type is dropped; turns are ordered by turn (null
    first), then role, then text, then placeholders, so repeated turn numbers have a fixed order; turns without
    a conversation id form one conversation with a null id. The work per turn is done before
    the turns meet; only the joining, whose result is one string, takes a conversation's
    turns together.
    """
    content = F.col(parts_col).cast(PART_TYPE) if parts_col else text_parts(F.col(text_col))
    base = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(content, F.array().cast(PART_TYPE)).alias("parts"))
    known = F.filter("parts", lambda p: p.isNotNull() & p["type"].isin("text", "image", "audio", "document"))
    media = F.filter("parts", lambda p: p["type"] != "text")
    # the visitor: neighbouring texts are one run, escaped when a placeholder or the end closes it
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("run"), F.lit(0).alias("media"))

    def visit(at: Column, p: Column) -> Column:
        text = p["type"] == "text"
        placeholder = F.concat(F.lit("<|"), p["type"], F.lit(":"), at["media"].cast("string"), F.lit("|>"))
        return F.struct(F.when(text, at["done"]).otherwise(F.concat(at["done"], escape(at["run"]), placeholder)).alias("done"),
                        F.when(text, F.concat(at["run"], F.coalesce(p["text"], F.lit("")))).otherwise("").alias("run"),
                        F.when(text, at["media"]).otherwise(at["media"] + 1).alias("media"))
    shown = F.aggregate("parts", begin, visit, lambda at: F.concat(at["done"], escape(at["run"])))
    plain = F.array_join(F.transform("parts", lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise("")), "")
    visited = (base.withColumn("parts", known)
               .withColumn("body", shown).withColumn("plain", plain)
               .withColumn("media", F.transform(media, lambda p, k: F.struct(
                   k.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"),
                   _tokens(p, patch, audio_rate, page_tokens).alias("tokens"))))
               .withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
               .withColumn("piece", F.concat("head", "body", F.lit(END), F.lit("\n"))))
    order = [F.col("turn").asc_nulls_first(), "role", "plain", "body"]
    by_turn = Window.partitionBy("conv").orderBy(*order)
    before = F.coalesce(F.sum(F.char_length("piece")).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (visited.withColumn("number", F.row_number().over(by_turn))
              .withColumn("begin", before + F.char_length("head"))
              .withColumn("end", F.col("begin") + F.char_length("body")))
    turn = F.struct("number", "piece", "role", "begin", "end", "media")
    joined = placed.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                        lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end")))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["media"], lambda m: F.struct(
        t["number"].alias("turn"), m["number"].alias("number"), m["type"].alias("type"), m["ref"].alias("ref"),
        m["tokens"].alias("tokens")))))
    out = joined.select("conv", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                        spans.alias("loss_spans"), attachments.alias("attachments"), F.size("turns").cast("long").alias("n_turns"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    raw = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.lit(1), F.size(F.split(formatted, r"<\|im_start\|>"))))
    return F.transform(raw, lambda t: F.struct(
        unescape(F.substring_index(t, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(t, SEP, -1), END, 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
