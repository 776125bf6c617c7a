"""Chat formatting. Native: DataFrame operations only.

A turn's content is a list of typed parts. A visitor, one rule per kind, flattens them into the turn's body: text is
escaped, an image, audio or document part becomes a placeholder, and its reference and the number of tokens that it
expands to are recorded in order. Control strings inside texts are broken by a backslash, and so are backslashes, so
that `read_back` restores every text from the formatted string alone. Text parts that follow one another can't spell a control string together either:
a backslash goes before a part that might go on with one.

Turns go by (turn, role, text), nulls first, so ties and repeated rows have one order. Null roles and texts
are empty, null part lists have no parts, unknown kinds of part are refused when formatting runs. Columns beyond those named are ignored; no
rows give no conversations. Rows whose conv_id is null are one conversation. A conversation is one string, so it is
gathered in one row; Spark's 2 GB limit on a value is the limit of a conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What a text mustn't hold as it is: marks of this template, and of others that trainers may look for. Each is broken after its first character.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
#: Tokens per unit of an attachment: an image's tiles, an audio part's seconds, a document's pages.
PART_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


#: What may go on a control string that the text part before has begun. "<", "[" and backslashes can't, so a backslash before these is no other escape.
_GOES_ON = f"^[{''.join(re.escape(x) for x in sorted(set(''.join(c[1:] for c in CONTROLS)) - set('<[')))}]"


def visit(part: Column, before: Column) -> Column:
    """One part's contribution to the body. before: the part that it follows, or null."""
    joins = F.coalesce((before["kind"] == "text") & part["text"].rlike(_GOES_ON), F.lit(False))
    out = F.when(part["kind"] == "text", F.concat(F.when(joins, "\\").otherwise(""), escape(part["text"])))
    for kind in PART_TOKENS:
        out = out.when(part["kind"] == kind, F.lit(f"<|{kind}|>"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(part["kind"], F.lit("null")))).cast("string"))


def attachments_of(parts: Column) -> Column:
    """References and expanded token counts of the parts that aren't text, in order."""

    def note(p: Column) -> Column:
        tokens = F.lit(0).cast("long")
        for kind, n in PART_TOKENS.items():
            tokens = F.when(p["kind"] == kind, F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)) * n).otherwise(tokens)
        return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens.cast("long").alias("tokens"))

    return F.transform(F.filter(parts, lambda p: p["kind"] != "text"), note)


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text, or a column `parts` of PARTS_TYPE instead of text.

    Returns per conversation: conv_id, formatted, turn_starts (in code points), loss_spans (turn's place, start in
    the turn, length; code points), attachments (kind, ref, tokens), placeholder_tokens.
    """
    if parts is None:
        content = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
        tie = F.coalesce(F.col("text"), F.lit(""))
    else:
        content = F.coalesce(F.col(parts), F.array().cast(PARTS_TYPE))
        tie = F.to_json(content)
    role = F.coalesce(F.col("role"), F.lit(""))
    one = turns.select("conv_id", "turn", role.alias("role"), tie.alias("tie"), content.alias("content")).select(
        "conv_id",
        "turn",
        "role",
        "tie",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)).alias("head"),
        F.array_join(F.transform("content", lambda p, i: visit(p, F.get("content", i - 1))), "").alias("body"),
        attachments_of(F.col("content")).alias("attachments"),
    )
    turn = F.struct("turn", "role", "tie", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("head").alias("start"), F.length("body").alias("length"), "attachments")
    grouped = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    spans = F.filter(
        F.transform("t", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"), (x["role"] == "assistant").alias("loss"))),
        lambda s: s["loss"],
    )
    lengths = F.transform("t", lambda x: F.length(x["piece"]).cast("long"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        lengths.alias("turn_chars"),
        F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
    ).withColumn("placeholder_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """From `formatted` and `loss_spans`: conv_id, turns (role, text), losses (the text under each span), unescaped."""

    def plain(body: Column) -> Column:
        return unescape(F.regexp_replace(body, rf"<\|({'|'.join(PART_TOKENS)})\|>", ""))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|says\|>", -1)
        return F.struct(unescape(F.substring(halves[0], len(TURN) + 1, 1 << 30)).alias("role"), plain(halves[1]).alias("text"))

    pieces = F.split("formatted", r"<\|end\|>", -1)
    return (
        formatted.withColumn("__p", pieces)
        .withColumn("__p", F.slice("__p", F.lit(1), F.size("__p") - 1))
        .select(
            "conv_id",
            "formatted",
            F.transform("__p", turn).alias("turns"),
            F.transform("loss_spans", lambda s: plain(F.substring(F.element_at("__p", s["turn"] + 1), s["start"] + 1, s["length"]))).alias("losses"),
        )
    )


def chat_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted strings."""
    back = read_back(format_conversations(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
