"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, merged into blocks of adjacent turns of
one role, and concatenated. Template of a block (texts of merged turns are joined by ``[SEP]``):

    user ``[INST]..[/INST]``   system ``[SYS]..[/SYS]``   assistant ``<s>..</s>``
    any other role ``[ROLE]role[SEP]..[/ROLE]``

Control strings inside texts get one backslash after their first character (one more if there are
some already), which ``unescape`` takes away again, so the format can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template's control strings.
TAIL = r"(/?s>|/?(?:INST|SYS|ROLE)\]|SEP\])"
OPEN = {"user": "[INST]", "system": "[SYS]", "assistant": "<s>"}
CLOSE = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
SEP = "[SEP]"
_BLOCK = r"(?s)(?:<s>|\[INST\]|\[SYS\]|\[ROLE\]).*?(?:</s>|\[/INST\]|\[/SYS\]|\[/ROLE\])"
_FIRST = r"^(?:<s>|\[INST\]|\[SYS\]|\[ROLE\])"
_LAST = r"(?:</s>|\[/INST\]|\[/SYS\]|\[/ROLE\])$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, "$1$2$3")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (code points of ``formatted``, end exclusive), one row a
    conversation.

    Rows need conv_id, turn, role, text; other columns are ignored. Turns are sorted by turn, then
    role and text (ties and repeated rows are kept, in that order; a null turn comes first). Null
    text and null role count as empty. Null conv_ids form one conversation. loss_spans cover each
    assistant text, without markers and separators. Empty table: empty result. A conversation is
    one output row, so it must fit a task; conversations are dealt out by conv_id.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opened = F.concat(F.lit("[ROLE]"), escape(role), F.lit(SEP))
    closed = F.lit("[/ROLE]")
    for r in OPEN:
        opened = F.when(role == r, F.lit(OPEN[r])).otherwise(opened)
        closed = F.when(role == r, F.lit(CLOSE[r])).otherwise(closed)
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
                    escape(text).alias("body"), opened.alias("opened"), closed.alias("closed"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # index of the first turn of each block, then the block's texts as one slice
    chats = chats.withColumn("starts", F.expr(
        "filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[i - 1].role)"))
    chats = chats.withColumn("blocks", F.expr("""
        transform(starts, (s, k) -> named_struct('opened', t[s].opened, 'closed', t[s].closed, 'loss', t[s].role = 'assistant',
            'texts', transform(slice(t, s + 1, coalesce(get(starts, k + 1), size(t)) - s), x -> x.body)))"""))
    joined = f"concat(b.opened, array_join(b.texts, '{SEP}'), b.closed)"
    spans = f"""aggregate(b.texts, named_struct('at', a.at + length(b.opened), 'spans', a.spans), (c, x) -> named_struct(
        'at', c.at + length(x) + {len(SEP)},
        'spans', concat(c.spans, array(named_struct('start', c.at, 'end', c.at + length(x))))))"""
    none = "cast(array() as array<struct<start: int, end: int>>)"
    return chats.select(
        "conv_id", F.expr(f"array_join(transform(blocks, b -> {joined}), '')").alias("formatted"),
        F.expr(f"""aggregate(blocks, named_struct('at', 0, 'spans', {none}), (a, b) -> named_struct(
            'at', a.at + length({joined}),
            'spans', case when b.loss then {spans}.spans else a.spans end)).spans""").alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    blocks = F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(0))

    def turns(block: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(block, _FIRST, ""), _LAST, "")
        parts = F.split(body, r"\[SEP\]", -1)
        role = unescape(F.get(parts, F.lit(0)))
        texts = F.slice(parts, 2, F.size(parts))
        for r, o in OPEN.items():
            role = F.when(block.startswith(o), F.lit(r)).otherwise(role)
            texts = F.when(block.startswith(o), parts).otherwise(texts)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and concatenated."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
