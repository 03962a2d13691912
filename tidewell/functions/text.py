"""String helpers: Column to Column, JVM-side. Trims are Unicode-aware where Spark's own are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trim_ws(c: Column) -> Column:
    """T5: strip Unicode white space at both ends (``trim`` strips U+0020 only)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case only."""
    return F.translate(c, UPPER, UPPER.lower())


def upper_ascii(c: Column) -> Column:
    return F.translate(c, UPPER.lower(), UPPER)


def lines(body: Column) -> Column:
    """Lines ended by LF or CRLF; no empty line after a final terminator."""
    return F.split(F.regexp_replace(body, r"\r?\n\z", ""), r"\r?\n")


def tokens(line: Column) -> Column:
    """Pieces between blanks, commas and semicolons, without empty ones."""
    return F.filter(F.split(line, r"[ \t\x0B\f\r,;]"), lambda t: t != "")


def words_ws(text: Column) -> Column:
    """T4: pieces between runs of Unicode white space, without empty ones."""
    return F.filter(F.split(text, f"{WS}+"), lambda t: t != "")


def before_first(c: Column, mark: str) -> Column:
    """What stands before the first mark (everything, if there is none)."""
    return F.substring_index(c, mark, 1)


def after_first(c: Column, mark: str) -> Column:
    return F.when(F.contains(c, F.lit(mark)), F.substring(c, F.instr(c, mark) + len(mark), F.length(c)))


def before_last(c: Column, mark: str) -> Column:
    tail = F.substring_index(c, mark, -1)
    return F.when(F.contains(c, F.lit(mark)), F.left(c, F.length(c) - F.length(tail) - len(mark)))


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def count_of(c: Column, mark: str) -> Column:
    """Occurrences of a one-character mark."""
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


# The six character references that are undone, in this order.
ENTITIES = [("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def unescape_html(c: Column) -> Column:
    """Replace the six references in order, ``&amp;`` last."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def base64_text(c: Column) -> Column:
    """Decode base64 with missing padding repaired; NULL for garbage and for blank results."""
    raw = trim_ws(c)
    text = trim_ws(F.try_to_binary(raw, F.lit("base64")).cast("string"))
    return F.when(text != "", text)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns that later expressions may use many times, each computed once a row.

    A plain projection would be inlined into every use by predicate pushdown, and layers of such columns grow the
    plan exponentially. A one-row generator is a fence for that and stays inside whole-stage codegen.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
