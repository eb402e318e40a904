r"""Operator 9: chat formatting with a grammar round trip, with DataFrame functions only.

Grammar of the output, read by one regular, deterministic parser:

    conversation = turn*
    turn         = "### " role ": " text "</turn>\n"

In role and text a backslash quotes the next character; an unquoted "###" or "</turn>" may
stand in neither, and an unquoted ":" not in a role. A turn is rendered as it is, parsed
again, and compared with its source; if they differ (control strings or backslashes in the
content), it is rendered with quotes instead, which always reads back as its source.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then
text (a null turn first); repeated rows stay repeated; a null conv_id is a conversation of
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: Possessive quantifiers: no backtracking, and no recursion over long texts.
_ROLE = r"((?:[^\\:#<]++|\\.|#(?!##)|<(?!/turn>))*+)"
_TEXT = r"((?:[^\\#<]++|\\.|#(?!##)|<(?!/turn>))*+)"
TURN = rf"(?s)### {_ROLE}: {_TEXT}</turn>\n"
ONE_TURN = rf"(?s)\A### {_ROLE}: {_TEXT}</turn>\n\z"
LEARNT_ROLE = "assistant"


def _quote(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, "#(?=##)", r"\\#")
    return F.replace(c, F.lit("</turn>"), F.lit("\\</turn>"))


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column) -> Column:
    # "##" + "</turn>" and ": " can't join with the marks into another control string
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(CLOSE))


def render_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with rendered: as it is if that reads back alike, else quoted."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = clean.withColumn("raw", _render(F.col("role"), F.col("text")))
    again = F.col("raw").rlike(ONE_TURN) & (unquote(F.regexp_extract("raw", ONE_TURN, 1)) == F.col("role")) & (unquote(F.regexp_extract("raw", ONE_TURN, 2)) == F.col("text"))
    quoted = _render(F.replace(_quote(F.col("role")), F.lit(":"), F.lit("\\:")), _quote(F.col("text")))
    return raw.select("conv_id", "turn", "role", "text", F.when(again, F.col("raw")).otherwise(quoted).alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, source (array of role, text)."""
    grouped = render_turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and turns: array of (role, text, loss) read from the formatted text."""
    parsed = formatted.withColumn("parts", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)))
    fields = F.transform(
        "parts",
        lambda p: F.struct(unquote(F.regexp_extract(p, TURN, 1)).alias("role"), unquote(F.regexp_extract(p, TURN, 2)).alias("text")),
    )
    # the parser must have read every character
    whole = F.length(F.array_join("parts", "")) == F.length("formatted")
    turns = F.transform(fields, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == LEARNT_ROLE).alias("loss")))
    return parsed.select(*formatted.columns, whole.alias("whole"), turns.alias("turns"))


def round_trip(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and identical: whether the turns that were read back are the source's."""
    parsed = parse_conversations(format_conversations(turns))
    back = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return parsed.select("conv_id", "formatted", "turns", (F.col("whole") & (back == F.col("source"))).alias("identical"))


def digest(done: DataFrame) -> DataFrame:
    """The columns of the query, from what was read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return done.withColumns({"loss_text": loss}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
