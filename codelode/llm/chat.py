"""Chat formatting with DataFrame expressions only.

Rows of a conversation are collected as structs and sorted by turn, adjacent turns of one
role are merged into a block, and the blocks are concatenated. Every control string that
occurs in a text or role is escaped reversibly, so a text can never end its own turn.

Null, tie and odd cases: a null text or role is empty; null conv_ids form one conversation;
turns sort with null first, ties by role and then text; repeated rows are turns of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import in_chunks

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: (control string, escape); the first escapes the escape sign itself.
ESCAPES = (("~", "~0"), ("<|", "~1"), ("[INST]", "~2"), ("[/INST]", "~3"), ("<s>", "~4"), ("</s>", "~5"))

#: Code points in a block of ``parse_chats``.
CUT = 4096


def escape(text: Column) -> Column:
    """Replace control strings; ``unescape`` gives the text back."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text", loss_role="assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``, code point spans of the texts to learn from.

    A block is ``<|turn|>role<|text|>text[<|next|>text ...]<|end|>``.
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
            (F.coalesce(F.col(role), F.lit("")) == loss_role).alias("loss"),
        ).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    starts = F.expr("filter(sequence(1, size(ts)), i -> i = 1 or ts[i - 1].role <> ts[i - 2].role)")
    blocked = sorted_turns.withColumn("starts", starts).withColumn(
        "blocks",
        F.expr(
            "transform(starts, (s, k) -> named_struct('role', ts[s - 1].role, 'loss', ts[s - 1].loss, 'texts',"
            " transform(slice(ts, s, coalesce(try_element_at(starts, k + 2), size(ts) + 1) - s), x -> x.text)))"
        ),
    )
    pieces = F.expr(
        "flatten(transform(blocks, b -> transform(b.texts, (x, i) -> named_struct("
        f"'head', if(i = 0, concat('{TURN}', b.role, '{TEXT}'), '{NEXT}'), 'text', x,"
        f" 'tail', if(i = size(b.texts) - 1, '{END}', ''), 'loss', b.loss))))"
    )
    step = (
        "(a, p) -> named_struct('at', a.at + length(p.head) + length(p.text) + length(p.tail), 'spans',"
        " if(p.loss, concat(a.spans, array(named_struct('start', a.at + length(p.head),"
        " 'end', a.at + length(p.head) + length(p.text)))), a.spans))"
    )
    spans = F.expr(in_chunks("pieces", "length(x.head) + length(x.text) + length(x.tail)", step, "array<struct<start:bigint,end:bigint>>"))
    return blocked.withColumn("pieces", pieces).select(
        "conv_id",
        F.expr("array_join(transform(pieces, p -> concat(p.head, p.text, p.tail)), '')").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read ``formatted`` back: ``turns`` as array of (role, text), ``loss_texts`` as the texts under the mask."""
    blocks = F.expr(f"filter(split(formatted, '{TURN.replace('|', '[|]')}', -1), (b, i) -> i > 0)")
    turns = F.expr(
        f"flatten(transform(blocks, b -> transform(split(substr(b, instr(b, '{TEXT}') + {len(TEXT)},"
        f" length(b) - instr(b, '{TEXT}') - {len(TEXT) - 1} - {len(END)}), '{NEXT.replace('|', '[|]')}', -1),"
        f" x -> named_struct('role', substr(b, 1, instr(b, '{TEXT}') - 1), 'text', x))))"
    )
    plain = F.transform("raw_turns", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    # spans are cut from blocks of code points, as each cut from the whole would walk through all before it
    masked = F.expr(
        f"element_at(transform(array(regexp_extract_all(formatted, '(?s).{{1,{CUT}}}', 0)), z -> transform(loss_spans, s ->"
        f" substring(array_join(slice(z, cast(s.start div {CUT} + 1 as int), cast(s.end div {CUT} - s.start div {CUT} + 1 as int)), ''),"
        f" cast(s.start % {CUT} + 1 as int), cast(s.end - s.start as int)))), 1)"
    )
    learnt = F.transform(masked, unescape)
    return formatted.withColumn("blocks", blocks).withColumn("raw_turns", turns).select("conv_id", "formatted", plain.alias("turns"), learnt.alias("loss_texts"))
