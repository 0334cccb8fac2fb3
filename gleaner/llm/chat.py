"""Chat formatting with a grammar round trip: DataFrame functions only.

A conversation is rendered turn by turn as ``### Role: text``, a line feed and ``</turn>`` with a line
feed. The grammar's control strings are the turn headers and ``</turn>``. A deterministic parser (one
regular expression for a turn, one for escapes) reads the rendered text back. Texts whose own rendering
does not come back alone and unchanged, or that hold a control string, get one backslash before each
control string (behind the backslashes that already precede it); rendering and parsing are then repeated
over the whole conversation and must give the source turns. Every pattern reads a text once, whatever it
holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles that the template names itself; any other role travels as hexadecimal UTF-8.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
_HEADER = r"### (?:User|Assistant|System|Null|Other\([0-9A-F]*\)): "
_CONTROL = rf"({_HEADER}|</turn>)"
_TURN = r"(?s)\G### (User|Assistant|System|Null|Other\([0-9A-F]*\)): (.*?)\n</turn>\n"


def escaped(text: Column) -> Column:
    """One backslash more before every control string."""
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    """One backslash fewer before every control string that has any."""
    return F.regexp_replace(text, r"\\" + _CONTROL, "$1")


def header(role: Column) -> Column:
    named = F.when(role.isNull(), F.lit("Null"))
    for name, shown in ROLES.items():
        named = named.when(role == name, F.lit(shown))
    return F.concat(F.lit("### "), named.otherwise(F.concat(F.lit("Other("), F.hex(F.encode(role, "UTF-8")), F.lit(")"))), F.lit(": "))


def role_of(shown: Column) -> Column:
    """The role that a header names; null for Null."""
    named = F.when(shown == "Null", F.lit(None).cast("string"))
    for name, title in ROLES.items():
        named = named.when(shown == title, F.lit(name))
    return named.otherwise(F.decode(F.unhex(F.regexp_extract(shown, r"\((.*)\)", 1)), "UTF-8"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit("\n</turn>\n"))


def parsed(formatted: Column) -> Column:
    """array<struct<role, raw, text>> of the turns in a rendered text; ``raw`` is still escaped."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(role_of(r).alias("role"), t.alias("raw"), unescaped(t).alias("text")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Render conversations and read them back.

    Returns ``conv_id, formatted, turns, mask``: ``turns`` is what the parser recovered (role, raw, text),
    ``mask`` the loss mask as (start, length) spans of code points in ``formatted``, one for each
    assistant text (escaped as it stands there).

    Rows are put in order of turn, then role, then text, so that ties and repeated rows have one result
    (repeated rows are turns of their own); a null turn comes first; a null text is empty; a null role is
    kept; rows with a null conversation form one conversation. An empty table gives an empty result, other
    columns are ignored. A conversation whose turns did not come back would have a null ``formatted``; no text
    is known that does this. A conversation is one output value, so its turns meet in one row.
    """
    source = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    alone = F.get(parsed(rendered(F.col("_role"), F.col("_text"))), 0)
    survives = alone["text"].eqNullSafe(F.col("_text")) & alone["role"].eqNullSafe(F.col("_role"))
    conflict = ~survives | F.col("_text").rlike(f"{_HEADER}|</turn>")
    marked = source.withColumn("_body", F.when(conflict, escaped(F.col("_text"))).otherwise(F.col("_text")))
    whole = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text", "_body"))).alias("_rows"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("_rows", lambda r: rendered(r["_role"], r["_body"])), ""))
    whole = whole.withColumn("turns", parsed(F.col("formatted")))
    pairs = lambda rows, role, text: F.transform(rows, lambda r: F.struct(r[role].alias("role"), r[text].alias("text")))
    identical = pairs("_rows", "_role", "_text").eqNullSafe(pairs("turns", "role", "text"))
    whole = whole.withColumn("formatted", F.when(identical, F.col("formatted")))
    # start of each turn: lengths of the turns before it, as one fold over the recovered turns
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(rendered(t["role"], t["raw"]))).cast("long").alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + F.length(header(t["role"]))).cast("long").alias("start"), F.length(t["raw"]).cast("long").alias("length"))),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return whole.select("conv_id", "formatted", "turns", spans.alias("mask"))
