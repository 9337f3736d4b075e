"""Text clean-up that follows Python's notion of whitespace and line ends, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions.columns import col, let

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The line ends Python's str.splitlines() honours besides line feed and carriage return with line feed.
LINE_END = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

FENCE = "```"


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def universal_newlines(c: Column | str) -> Column:
    """Text-mode reading: carriage returns, alone or before a line feed, become line feeds."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def unify_line_ends(c: Column | str) -> Column:
    """Every line end as a line feed."""
    return F.regexp_replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), LINE_END, "\n")


def split_lines(c: Column | str) -> Column:
    return F.split(unify_line_ends(c), "\n")


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip `text` and drop the rows left without any."""
    return df.withColumn(text, strip(text)).where(F.col(text) != "")


def explode_lines(df: DataFrame, text: str = "text", out: str = "line") -> DataFrame:
    """One row per non-blank stripped line of `text`; the other columns are kept."""
    lines = df.withColumn(out, F.explode(split_lines(text))).drop(text)
    return clean_text(lines, out)


def unfence(c: Column | str) -> Column:
    """Stripped text without a surrounding code fence; a fence needs three lines or more to be removed."""

    def without_last(body: Column, rest: Column) -> Column:
        last = F.substring_index(rest, "\n", -1)
        inner = strip(F.left(rest, F.length(rest) - F.length(last)))
        return F.when(F.contains(rest, F.lit("\n")), inner).otherwise(body)

    def without_first(body: Column, lines: Column) -> Column:
        first = F.instr(lines, "\n")
        rest = F.when(first > 0, F.right(lines, F.length(lines) - first)).otherwise(F.lit(""))
        return let(rest, lambda rest: without_last(body, rest))

    def opened(body: Column) -> Column:
        unwrapped = let(unify_line_ends(body), lambda lines: without_first(body, lines))
        return F.when(body.startswith(FENCE), unwrapped).otherwise(body)

    return let(strip(c), opened)
