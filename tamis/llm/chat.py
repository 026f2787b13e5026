"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (turns in order, nothing between them)::

    conversation := block*
    block        := open body close
    open close   := <<SYS>> <</SYS>>  |  [INST] [/INST]  |  <s> </s>  |  [TURN] [/TURN]
                    (system)             (user)             (assistant)  (any other role)
    body         := text, of [TURN]: url-encoded role, newline, text

A text may hold control strings itself.  The conversation is first rendered as
it is and parsed again; where the recovered turns differ from the source, the
conflicting texts are escaped and the parse is repeated.  Escaping writes one
backslash after the first character of every control string, and one more where
backslashes stand there already (``</s>``, ``<\\/s>`` become ``<\\/s>``, ``<\\\\/s>``); the
parser takes one away.  The result is checked: an unequal round trip is an error.

Defined results: rows are ordered by (turn, role, text), nulls first; a null
text or role is empty; a null conv_id is a conversation of its own; repeated
rows are turns of their own; an empty table gives an empty result; other columns
are ignored.  One conversation is one output string, so its turns meet in one
row by nature; they are gathered by a partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, by role.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OPEN_OTHER, CLOSE_OTHER = "[TURN]", "[/TURN]"

#: what follows the first character of a control string
_REST = r"(/?s>|</?SYS>>|/?INST\]|/?TURN\])"
CONFLICT = r"([<\[])(\\*)" + _REST
_ESCAPED = r"([<\[])\\(\\*)" + _REST
_BLOCK = (r"(?s)(<<SYS>>|\[INST\]|<s>|\[TURN\])(.*?)(<</SYS>>|\[/INST\]|</s>|\[/TURN\])")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONFLICT, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _by_role(role: Column, marks: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _block(role: Column, text: Column) -> Column:
    head = F.when(role.isin(*OPEN), F.lit("")).otherwise(F.concat(F.url_encode(role), F.lit("\n")))
    return F.concat(_by_role(role, OPEN, OPEN_OTHER), head, text, _by_role(role, CLOSE, CLOSE_OTHER))


def render(turns: Column, escaped: bool) -> Column:
    """An array of (turn, role, text) as one string."""
    return F.array_join(F.transform(
        turns, lambda t: _block(t["role"], escape(t["text"]) if escaped else t["text"])), "")


def _first_that(test, marks: list[str]) -> Column:
    """The first of the marks for which ``test`` holds."""
    return F.coalesce(*[F.when(test(F.lit(m)), F.lit(m)) for m in marks])


def parse(formatted: Column) -> Column:
    """The blocks of a formatted conversation: array of (role, text, open, body, close)."""
    def one(block: Column) -> Column:
        opened = _first_that(lambda m: F.startswith(block, m), [*OPEN.values(), OPEN_OTHER])
        closed = _first_that(lambda m: F.endswith(block, m), [*CLOSE.values(), CLOSE_OTHER])
        body = F.substring(block, F.length(opened) + 1, F.length(block) - F.length(opened) - F.length(closed))
        role = F.when(opened == OPEN_OTHER, F.url_decode(F.substring_index(body, "\n", 1)))
        for name, mark in OPEN.items():
            role = role.when(opened == mark, F.lit(name))
        text = F.when(opened == OPEN_OTHER, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"),
                        opened.alias("open"), body.alias("body"), closed.alias("close"))
    return F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(0)), one)


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))) == \
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text).

    Columns: conv_id, formatted, turns (role, text as parsed from ``formatted``),
    loss_mask (runs of (chars, loss) over the characters of ``formatted``; loss is
    true on the bodies of assistant blocks), loss_text (what the mask covers,
    unescaped) and escaped (whether the texts had to be escaped).
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("source"))
    first = (convs.withColumn("plain", render(F.col("source"), escaped=False))
             .withColumn("plain_turns", parse(F.col("plain")))
             .withColumn("escaped", ~_same(F.col("plain_turns"), F.col("source"))))
    second = (first
              .withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escaped=True))
                          .otherwise(F.col("plain")))
              .withColumn("blocks", F.when(F.col("escaped"), parse(F.col("formatted")))
                          .otherwise(F.col("plain_turns"))))
    checked = second.withColumn(
        "blocks", F.when(_same(F.col("blocks"), F.col("source")), F.col("blocks"))
        .otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))))
    loss = lambda b: b["open"] == OPEN["assistant"]
    run = lambda c, on: F.struct(F.length(c).alias("chars"), on.alias("loss"))
    return checked.select(
        "conv_id", "formatted",
        F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), b["text"].alias("text"))).alias("turns"),
        F.flatten(F.transform("blocks", lambda b: F.array(
            run(b["open"], F.lit(False)), run(b["body"], loss(b)), run(b["close"], F.lit(False))))).alias("loss_mask"),
        F.array_join(F.transform(F.filter("blocks", loss), lambda b: b["text"]), "").alias("loss_text"),
        "escaped")
