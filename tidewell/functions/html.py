"""H1-H8: endpoints out of HTML tables, links and text areas, by literal patterns (RE2-safe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import base64_text, bind, lower_ascii, trim_ws, unescape_html, upper_ascii, words_ws

CELL = r"(?s)^[^>]*>(.*?)</td>"
LINK = r'href="/([^"]*?)/([0-9]+)(?:#([^"]*))?"'
WORD = r"\b(socks5|socks4|https|http)\b"
PAIR = r"(?s)<td>\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3})\s*</td>\s*<td>\s*([0-9]{2,5})\s*</td>"
FIRST_TABLE = r'(?is)<table[^>]*class="layui-table"[^>]*>(.*?)(?:</table>|<table|\z)'
TEXTAREA = r"(?s)<textarea[^>]*>(.*?)</textarea>"


def rows(html: Column) -> Column:
    """H1: what follows each ``<tr``."""
    parts = F.split(html, "<tr", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def cells(row: Column) -> Column:
    """H2: trimmed texts of closed cells; an empty closed cell keeps its place."""
    parts = F.split(row, "<td", -1)
    own = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(F.filter(own, lambda c: c.rlike(CELL)), lambda c: trim_ws(F.regexp_extract(c, CELL, 1)))


def _exploded(df: DataFrame, html: str) -> DataFrame:
    return df.select("*", F.posexplode(rows(F.col(html))).alias("row_ix", "_row"))


def _raw(df: DataFrame, scheme: Column, host: Column, port: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    out = bind(df, **{"scheme": scheme, "host": host, "port": port, "user": none, "pass": none})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def link_fields(row: Column, default: Column) -> tuple[Column, Column, Column]:
    """H3: scheme, host and port of a row's ``/host/port#proto`` link; the scheme is the fragment's, else the first word of the row's, else the default."""
    from tidewell.functions.scheme import canon

    word = F.regexp_extract(lower_ascii(row), WORD, 1)
    scheme = F.coalesce(canon(F.regexp_extract(row, LINK, 3)), canon(word), default)
    return scheme, F.regexp_extract(row, LINK, 1), F.regexp_extract(row, LINK, 2)


def base64_fields(row: Column, default: Column) -> tuple[Column, Column, Column]:
    """H4: base64 ``data-ip`` and ``data-port`` of the same row."""
    return default, base64_text(F.regexp_extract(row, 'data-ip="([^"]+)"', 1)), base64_text(F.regexp_extract(row, 'data-port="([^"]+)"', 1))


def web_scheme(texts: Column) -> Column:
    """H6: HTTP or HTTPS in the fourth of at least four cells."""
    label = upper_ascii(F.get(texts, F.lit(3)))
    return F.when(label == "HTTP", "http").when(label == "HTTPS", "https")


def socks_scheme(texts: Column) -> Column:
    """H7: Socks4 or Socks5 in the fifth of five cells."""
    label = F.replace(lower_ascii(F.get(texts, F.lit(4))), F.lit(" "), F.lit(""))
    return F.when(label.isin("socks4", "socks5"), label)


def link_rows(df: DataFrame, html: str, default: str) -> DataFrame:
    return _raw(_exploded(df, html).filter(F.col("_row").rlike(LINK)), *link_fields(F.col("_row"), F.col(default)))


def base64_rows(df: DataFrame, html: str, default: str) -> DataFrame:
    return _raw(_exploded(df, html), *base64_fields(F.col("_row"), F.col(default)))


def pairs(html: Column) -> Column:
    """H5: neighbouring address and port cells of the first layui table."""
    table = F.regexp_extract(html, FIRST_TABLE, 1)
    return F.arrays_zip(F.regexp_extract_all(table, F.lit(PAIR), F.lit(1)).alias("h"), F.regexp_extract_all(table, F.lit(PAIR), F.lit(2)).alias("p"))


def table_pairs(df: DataFrame, html: str) -> DataFrame:
    """H5: always http."""
    d = df.select("*", F.posexplode(pairs(F.col(html))).alias("row_ix", "_pair"))
    return _raw(d, F.lit("http"), F.col("_pair.h"), F.col("_pair.p"))


def column_rows(df: DataFrame, html: str, kind: str) -> DataFrame:
    """H6 (``web``) and H7 (``socks``)."""
    d = bind(_exploded(df, html), _c=cells(F.col("_row")))
    d = bind(d, _s=(web_scheme if kind == "web" else socks_scheme)(F.col("_c"))).filter(F.col("_s").isNotNull())
    return _raw(d, F.col("_s"), F.get("_c", F.lit(0)), F.get("_c", F.lit(1)))


def textarea_words(html: Column) -> Column:
    """H8: entry tokens of the first text area, character references undone."""
    return words_ws(F.when(html.rlike(TEXTAREA), unescape_html(F.regexp_extract(html, TEXTAREA, 1))))


def textarea_tokens(df: DataFrame, html: str, out: str = "token") -> DataFrame:
    return df.select("*", F.posexplode(textarea_words(F.col(html))).alias("row_ix", out))
