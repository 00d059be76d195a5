"""Chat formatting: turns to one training text a conversation with a loss mask, and back, by Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role are merged into a block by array functions, and blocks are
concatenated. The shape is

    <s>[SYS]text[/SYS][INST]text[TURN]text[/INST]text</s>...

with [TURN] between the turns of a block; roles other than system, user and assistant stand as [ROLE]name[TEXT]text[/ROLE].
A control string inside a text, with any number of backslashes after its first character, gets one backslash more there, and
reading takes one away: no text can forge a mark and every text comes back as it was. The first character of a mark occurs
nowhere else in it, so neither escapes nor neighbours make new marks.

Rows are ordered by turn (null first), then role, then text; repeated rows are turns of their own. A null text is empty and a
null role is an empty name. Rows without a conversation id are one conversation, whose id is null. Empty tables give empty
ones; columns other than the four are not read. A conversation is one value, so its text must fit one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, NEXT, ROLE, TEXT = "<s>", "[TURN]", "[ROLE]", "[TEXT]"
#: Opening and closing marks of the roles with marks of their own; other roles close with OTHER.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
OTHER = "[/ROLE]"
LEARNED = "assistant"
#: What follows the first character of a mark, for escaping (no or more backslashes) and reading (one or more).
_HEAD = r"(<(?=\\{0}/?s>)|\[(?=\\{0}(?:/?INST|/?SYS|/?ROLE|TEXT|TURN)\]))"
_BLOCK_ENDS = r"(?<=</s>|\[/INST\]|\[/SYS\]|\[/ROLE\])"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def escape(text: Column) -> Column:
    """The text with one backslash more in every control string."""
    return F.regexp_replace(text, _HEAD.replace("{0}", "*"), r"$1\\")


def unescape(text: Column) -> Column:
    """The text with one backslash less in every escaped control string."""
    return F.regexp_replace(text, _HEAD.replace("{0}", "+") + r"\\", "$1")


def _by_role(role: Column, which: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[which])).otherwise(out)
    return out


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role: the positions where the role changes, and the slices between them."""
    changes = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(changes, 2, F.size(turns)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(changes.alias("start"), ends.alias("end")),
        lambda b: F.struct(
            F.get(turns, b["start"])["role"].alias("role"),
            F.transform(F.slice(turns, b["start"] + 1, b["end"] - b["start"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def _pieces(block: Column) -> Column:
    """Marks and escaped texts of a block in order, each with whether it is learned."""

    def mark(s: Column) -> Column:
        return F.struct(s.alias("piece"), F.lit(False).alias("learned"))

    role = block["role"]
    opening = _by_role(role, 0, F.concat(F.lit(ROLE), escape(role), F.lit(TEXT)))
    inner = F.transform(
        block["texts"],
        lambda t, i: F.array(mark(F.when(i == 0, opening).otherwise(F.lit(NEXT))), F.struct(escape(t).alias("piece"), (role == LEARNED).alias("learned"))),
    )
    return F.concat(F.flatten(inner), F.array(mark(_by_role(role, 1, F.lit(OTHER)))))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, blocks (role, texts), formatted, and loss_spans: byte ranges of the formatted UTF-8 text that are learned.

    One shuffle, by conversation. Work is linear in a conversation but for its list of spans.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    begin = F.array(F.struct(F.lit(BEGIN).alias("piece"), F.lit(False).alias("learned")))
    chats = chats.select("conv_id", "blocks", F.concat(begin, F.flatten(F.transform("blocks", _pieces))).alias("pieces"))
    walk = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.octet_length(p["piece"])).alias("at"),
            F.when(p["learned"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.octet_length(p["piece"])).alias("end")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return chats.select("conv_id", "blocks", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), walk["spans"].alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, from its marks alone."""

    def turns_of(block: Column) -> Column:
        def inside(marks: tuple[str, str]) -> Column:
            return F.substring(block, F.lit(len(marks[0]) + 1), F.char_length(block) - len(marks[0] + marks[1]))

        other = inside((ROLE, OTHER))
        name, body = unescape(F.substring_index(other, TEXT, 1)), F.substring_index(other, TEXT, -1)
        for role, marks in MARKS.items():
            closes = block.endswith(marks[1])
            name, body = F.when(closes, F.lit(role)).otherwise(name), F.when(closes, inside(marks)).otherwise(body)
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.substring(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted)), _BLOCK_ENDS, -1)
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns_of))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    raw = F.encode(formatted, "UTF-8")

    def read(s: Column) -> Column:
        return unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"))

    return F.array_join(F.transform(spans, read), "")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and learned, the last two read from formatted and loss_spans."""
    return chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
