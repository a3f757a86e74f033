r"""Chat formatting with a grammar round trip, in DataFrame operations only.

    conversation := turn*          turn := "### " role ": " text "</turn>" "\n"

Inside a role or a text a backslash takes the next character as it is.  Each turn is first rendered as it is
and parsed again; only where the parser does not give back the same role and text are control strings escaped,
and the result is parsed again.  The whole conversation is then parsed and compared once more; one that still
differs ends the job, so no output can be read back wrongly.

Defined cases: null role and null text are empty; turns sort by turn number (null first), then role, then text,
so repeated turns stay, side by side; rows with a null conversation identifier form one conversation; an empty
table gives an empty result; other columns are not looked at.  A conversation is one output row, so its turns
meet in one task; rows are rendered, parsed and escaped before that, wherever they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import whole

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
SLASH = "\\"


def escape(text: Column) -> Column:
    """Break every control string; `unescape` gives the text back."""
    out = F.replace(text, F.lit(SLASH), F.lit(SLASH * 2))
    out = F.replace(out, F.lit(CLOSE), F.lit("<" + SLASH + CLOSE[1:]))
    out = F.replace(out, F.lit(OPEN), F.lit(SLASH + OPEN))
    return F.replace(out, F.lit(MIDDLE), F.lit(SLASH + MIDDLE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE + "\n"))


def parse(rendered: Column) -> Column:
    """Array of (role, text); a turn that the grammar does not allow comes out as null.

    One pass over the pieces between end marks.  A piece must begin with the line break of the turn before and
    one opening mark, and hold no further opening mark that is not escaped.
    """
    pieces = F.split(rendered, CLOSE, -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column, at: Column) -> Column:
        start = F.when(at == 0, F.lit(OPEN)).otherwise(F.lit("\n" + OPEN))
        body = F.substr(piece, F.char_length(start) + 1)
        role = F.regexp_extract(body, r"(?s)^((?:[^\\:]|\\.|:(?! ))*+): ", 1)
        rest = F.substr(body, F.char_length(role) + 1 + len(MIDDLE))
        valid = (
            F.startswith(piece, start)
            & F.startswith(F.substr(body, F.char_length(role) + 1), F.lit(MIDDLE))
            & ~F.rlike(body, F.lit(r"(?<!\\)### "))
        )
        return F.when(valid, F.struct(unescape(role).alias("role"), unescape(rest).alias("text")))

    return F.when(F.element_at(pieces, -1) == F.when(F.size(pieces) == 1, F.lit("")).otherwise(F.lit("\n")),
                  F.transform(turns, turn))


def _same(parsed: Column, turns: Column) -> Column:
    return F.coalesce(parsed == turns, F.lit(False))


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: formatted text, the recovered turns, and the spans under the loss mask.

    `loss_spans` holds (start, length) in code points of the formatted text, start counted from 0.
    """
    role, text = whole(role_col), whole(text_col)
    turns = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    )
    source = F.array(F.struct("role", "text"))
    plain = _same(parse(render(F.col("role"), F.col("text"))), source)
    turns = turns.withColumn("plain", plain).select(
        "conv", "turn", "role", "text",
        F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"))).alias("shown_role"),
        F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))).alias("shown_text"),
    )
    grouped = turns.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown_role", "shown_text"))).alias("turns")
    )
    formatted = grouped.select(
        "conv",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform("turns", lambda t: render(t["shown_role"], t["shown_text"])).alias("rendered"),
        F.transform("turns", lambda t: F.struct(
            (t["role"] == loss_role).alias("loss"),
            F.char_length(render(t["shown_role"], t["shown_text"])).alias("all"),
            F.char_length(t["shown_role"]).alias("before"),
            F.char_length(t["shown_text"]).alias("length"),
        )).alias("sizes"),
    ).withColumn("formatted", F.array_join("rendered", ""))
    # Running offsets: start of a turn = length of all turns before it.
    spans = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["all"]).alias("at"),
            F.when(s["loss"], F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["before"] + len(OPEN) + len(MIDDLE)).alias("start"), s["length"].alias("length")
            )))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    parsed = formatted.select(
        F.col("conv").alias(conv_col), "formatted", "source",
        parse(F.col("formatted")).alias("parsed"), spans.alias("loss_spans"),
    )
    checked = F.when(_same(F.col("parsed"), F.col("source")), F.col("parsed")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not parse back to its turns"))
    )
    return parsed.select(conv_col, "formatted", checked.alias("turns"), "loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, in order, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), ""
    )
