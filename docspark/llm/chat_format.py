r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block by
array aggregation; blocks are concatenated. A block is <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>, and the texts that
a block merged are parted by <|im_turn|>, so that the turns can be read back.

A backslash inside a text or role is doubled, and one is put after the first character of whatever spells a control
string (these marks, <s>, </s>, [INST], [/INST], <<SYS>> and the like), so none remains; taking the
character after each backslash undoes both.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role, then text, so
ties and repeated rows are kept in a fixed order; no rows, no conversations. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
#: What begins a control string: its first character, seen before the rest.
CONTROL = r"([<\[])(?=\|[A-Za-z_0-9]+\|>|/?s>|/?INST\]|</?SYS>>)"
TRAINED_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): the sorted turns of each conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(F.col(id)).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def merge(turns: Column) -> Column:
    """Blocks (role, text) of escaped turns, adjacent ones of one role merged."""
    empty = F.array().cast("array<struct<role:string,text:string>>")

    def step(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        own = F.struct(escape(t.role).alias("role"), escape(t.text).alias("text"))
        joined = F.struct(last.role.alias("role"), F.concat(last.text, F.lit(TURN), own.text).alias("text"))
        return F.when((F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1)).role == own.role), F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(joined))).otherwise(F.concat(blocks, F.array(own)))

    return F.aggregate(turns, empty, step)


def render(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit(START), b.role, F.lit(SEP), b.text, F.lit(END))), "")


def loss_spans(blocks: Column, roles: tuple[str, ...] = TRAINED_ROLES) -> Column:
    """(start, end) code points in the rendered string of each trained role's texts, the marks between them left out."""
    init = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def part(acc: Column, t: Column) -> Column:
        end = acc.at + F.length(t)
        return F.struct((end + len(TURN)).alias("at"), F.concat(acc.spans, F.array(F.struct(acc.at.alias("start"), end.alias("end")))).alias("spans"))

    def step(acc: Column, b: Column) -> Column:
        begin = acc.at + len(START) + F.length(b.role) + len(SEP)
        inner = F.aggregate(F.split(b.text, r"<\|im_turn\|>", -1), F.struct(begin.cast("bigint").alias("at"), acc.spans.alias("spans")), part)
        spans = F.when(b.role.isin(*roles), inner.spans).otherwise(acc.spans)
        return F.struct((begin + F.length(b.text) + len(END)).cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(blocks, init, step, lambda acc: acc.spans)


def format_chats(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, formatted, loss_spans): one row per conversation."""
    merged = conversations(rows, id=id, turn=turn, role=role, text=text).select(F.col(id), merge(F.col("turns")).alias("blocks"))
    return merged.select(F.col(id), render(F.col("blocks")).alias("formatted"), loss_spans(F.col("blocks")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn, read back from a formatted string."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 2147483646)

    def turns(b: Column) -> Column:
        both = F.split(b, r"<\|im_sep\|>", -1)
        texts = F.split(F.regexp_replace(both[1], r"<\|im_end\|>$", ""), r"<\|im_turn\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(both[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
