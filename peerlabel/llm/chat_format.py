r"""Conversations as training text, with a grammar that reads them back.

    conversation := turn*
    turn         := "### " role ": " text "</turn>\n"
    role, text   := (escape | character)*
    escape       := "\" character

Inside a text no unescaped "### " or "</turn>" may stand, in a role no unescaped ":" either. An
escape of ``\``, ``#``, ``<`` or ``:`` stands for that character alone; before any other a
backslash is a backslash. The grammar is read from left to right with no choice at any point.

Every turn is rendered as it is, read back and compared with its source. What
does not come back is rendered with its control strings escaped, and what still does not,
with its backslashes escaped as well; the last always comes back.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
# Possessive loops run in constant stack space, however long a text is.
ROLE = r"((?:[^\\<#:]++|\\.|<(?!/turn>)|#(?!## ))*+)"
TEXT = r"((?:[^\\<#]++|\\.|<(?!/turn>)|#(?!## ))*+)"
TURN = rf"(?s)\G### {ROLE}: {TEXT}</turn>\n"
ESCAPED = r"\\([\\#<:])"
CONTROLS = r"### |</turn>"


def unescape(part: Column) -> Column:
    return F.regexp_replace(part, ESCAPED, "$1")


def escape(part: Column, what: str) -> Column:
    return F.regexp_replace(part, f"({what})", r"\\$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text as they stand there, up to the first fault."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text, unescaped; NULL where it
    does not follow the grammar to its end."""

    def turn(piece: Column) -> Column:
        return F.struct(
            unescape(F.regexp_extract(piece, TURN, 1)).alias("role"),
            unescape(F.regexp_extract(piece, TURN, 2)).alias("text"),
        )

    def read(found: Column) -> Column:
        return F.when(F.array_join(found, "") == formatted, F.transform(found, turn))

    return let(pieces(formatted), read)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, also where it is used in loops."""
    return F.element_at(F.transform(F.array(value), then), 1)


@dataclass(frozen=True)
class ChatFormatter:
    """``loss_role``: the role whose texts are under the loss mask."""

    loss_role: str = "assistant"

    def turns(self, rows: DataFrame) -> DataFrame:
        """(conv_id, turn, role, text, escapes, header, body, rendered) of every row.

        ``escapes`` tells how far a turn had to be escaped: 0 not at all, 1 control strings,
        2 backslashes too. NULL roles and texts are empty.
        """
        role = F.coalesce(F.col("role").cast("string"), F.lit(""))
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        known = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        forms = (
            (F.col("role"), F.col("text")),
            (escape(F.col("role"), f"{CONTROLS}|:"), escape(F.col("text"), CONTROLS)),
            (escape(F.col("role"), rf"{CONTROLS}|:|\\"), escape(F.col("text"), rf"{CONTROLS}|\\")),
        )
        source = F.array(F.struct("role", "text"))

        def comes_back(form: tuple[Column, Column]) -> Column:
            return F.coalesce(parse(render(*form)) == source, F.lit(False))

        level = F.when(comes_back(forms[0]), 0).when(comes_back(forms[1]), 1).otherwise(2)
        tried = known.withColumn("escapes", level)

        def chosen(i: int) -> Column:
            of = F.col("escapes")
            return F.when(of == 0, forms[0][i]).when(of == 1, forms[1][i]).otherwise(forms[2][i])

        made = tried.withColumn("header", F.concat(F.lit(OPEN), chosen(0), F.lit(MIDDLE))).withColumn("body", chosen(1))
        return made.withColumn("rendered", F.concat("header", "body", F.lit(CLOSE)))

    def format(self, rows: DataFrame) -> DataFrame:
        """(conv_id, n_turns, formatted, loss, round_trip) of every conversation of ``rows``.

        Turns stand in the order of ``turn``; of equal ones (NULL comes first) in that of
        role and text, and repeated rows each count. ``loss`` lists the spans under the loss mask
        as byte offsets [start, end) of the UTF-8 text. ``round_trip`` tells whether the whole
        text, parsed, gives the source's turns. A NULL conv_id is a conversation too; no rows
        give none; more columns are not looked at. A conversation is one text,
        so its rows have to meet in one task.
        """
        by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
        so_far = F.sum(F.octet_length("rendered")).over(by_turn.rowsBetween(Window.unboundedPreceding, -1))
        start = F.coalesce(so_far, F.lit(0)) + F.octet_length("header")
        placed = self.turns(rows).select(
            "conv_id",
            F.struct(
                F.row_number().over(by_turn).alias("place"),
                "role",
                "text",
                "rendered",
                F.struct(start.cast("int").alias("start"), (start + F.octet_length("body")).cast("int").alias("end")).alias("span"),
            ).alias("of"),
        )
        gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("of")).alias("turns"))
        joined = gathered.withColumn("formatted", F.array_join(F.col("turns.rendered"), ""))
        source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        under = F.filter("turns", lambda t: t["role"] == self.loss_role)
        return joined.select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            "formatted",
            F.transform(under, lambda t: t["span"]).alias("loss"),
            F.coalesce(parse(F.col("formatted")) == source, F.lit(False)).alias("round_trip"),
        )


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, read from the formatted text and unescaped."""

    def cut(raw: Column) -> Column:
        def text(span: Column) -> Column:
            part = F.substring(raw, span["start"] + 1, span["end"] - span["start"])
            return unescape(F.decode(part, "UTF-8"))

        return F.array_join(F.transform(loss, text), "")

    return let(formatted.cast("binary"), cut)
