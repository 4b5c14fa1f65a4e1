r"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn         = "<|im_start|>" role "\n" text "<|im_end|>" "\n"

where neither role nor text holds `<|`. Of a text the parser takes one backslash out of every `<`, backslashes, `|`; in a
role it resolves `%0A`, `%3C` and `%25`. Each turn is first rendered as it is and parsed again; only
where the parser does not return the source exactly is the turn escaped, which then always does: the escape
puts one more backslash into every `<`, backslashes, `|`, so that no control string is left, and removing one undoes it.

Defined results: NULL role and NULL text count as empty; ties of `turn` are ordered by role, then text; repeated rows are
repeated turns; an empty table gives an empty result; other columns of the input are ignored. One
conversation becomes one training record, so its turns have to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: The end mark as a regular expression.
END_PATTERN = r"<\|im_end\|>\n"
#: `%` comes first when escaping and last when reading.
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    for sign, code in ROLE_CODES:
        role = F.replace(role, F.lit(sign), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for sign, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(sign))
    return role


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string as an array of (role, text); a piece that is no turn has NULL fields."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        good = piece.startswith(START) & (cut > 0) & ~body.contains("<|")
        role = F.when(good, unescape_role(F.substr(body, F.lit(1), cut - 1)))
        text = F.when(good, unescape_text(F.substr(body, cut + 1)))
        return F.struct(role.alias("role"), text.alias("text"))

    pieces = F.split(formatted, END_PATTERN, -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    # What follows the last end mark must be empty; otherwise it is a turn that was not ended.
    none = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    return F.when(F.element_at(pieces, -1) == "", turns).otherwise(F.concat(turns, none))


def rendered_turn(role: Column, text: Column) -> Column:
    """A turn that parses back to itself: as it is where that works, else with its conflicts escaped."""
    plain = render(role, text)
    same = parse(plain) == F.array(F.struct(role.alias("role"), text.alias("text")))
    return F.when(F.coalesce(same, F.lit(False)), plain).otherwise(render(escape_role(role), escape_text(text)))


def format_chats(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: `conv_id`, `formatted`, `mask`, `learned`, `turns`, `round_trip`.

    `mask` is an array of (start, end) in code points of `formatted`, end exclusive, in order, over the texts
    of the roles in `learn_from`; `learned` is all text under it, cut out of `formatted` and without escapes. `turns` are those read back
    from `formatted`; `round_trip` says whether they equal the source. Places come from a running sum over the turns, so the
    work grows in proportion to a conversation's length.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    ready = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "piece", rendered_turn(F.col("role"), F.col("text"))
    )
    in_turn = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    ready = ready.withColumn("at", F.sum(F.length("piece")).over(in_turn) - F.length("piece"))
    # No piece is empty, so places differ and give the order of the turns.
    item = F.struct("at", "role", "text", "piece")
    ordered = ready.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = ordered.select(
        "conv_id",
        F.array_join(F.col("items.piece"), "").alias("formatted"),
        F.transform("items", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform("items", lambda t: text_span(t, learn_from)).alias("marks"),
    )
    parsed = joined.withColumn("turns", parse(F.col("formatted")))
    return parsed.select(
        "conv_id",
        "formatted",
        F.transform(
            F.filter("marks", lambda m: m["learn"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
        ).alias("mask"),
        text_of_marks(F.col("formatted"), F.col("marks")).alias("learned"),
        "turns",
        (F.col("turns") == F.col("source")).alias("round_trip"),
    )


def text_span(item: Column, learn_from: tuple[str, ...]) -> Column:
    """Where a turn begins, where its text begins and ends in the formatted string, and whether it is learned."""
    # A role is rendered without line breaks, so the first one ends it.
    start = item["at"] + F.instr(item["piece"], "\n")
    end = item["at"] + F.length(item["piece"]) - len(END)
    return F.struct(
        item["at"].cast("int").alias("at"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        item["role"].isin(*learn_from).alias("learn"),
    )


def text_of_marks(formatted: Column, marks: Column) -> Column:
    """All text under the learned marks, one mark per turn, cut from the piece of the formatted string that begins at the mark's place."""

    def cut(piece: Column, mark: Column) -> Column:
        return F.when(mark["learn"], unescape_text(F.substr(piece, mark["start"] - mark["at"] + 1, mark["end"] - mark["start"])))

    return F.array_join(F.zip_with(F.split(formatted, END_PATTERN, -1), marks, cut), "")


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under any mask, without escapes, joined; every span is looked for from the start of the string, so it is for short ones."""
    pieces = F.transform(mask, lambda m: unescape_text(F.substr(formatted, m["start"] + 1, m["end"] - m["start"])))
    return F.array_join(pieces, "")
