"""Landed bodies to candidate records.

A body row has provider_id, ord, seed_ix, page_ix, url, label, default_scheme, parse_kind and body. Records keep
the four order columns (ord, seed_ix, page_ix, rec_ix), on which first-wins merging depends. Everything is narrow: the pieces
of a body (tokens, table rows, address pairs; or JSON elements) are chosen by its kind and unnested once, so line and HTML bodies
take one scan and JSON bodies another. A body gives at most ``RECORD_CAP`` records, so valid records meet by body (at most
``BYTE_CAP`` bytes each) to be numbered; what counts records by endpoint and body later has the same partitioning and shuffles no more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions.entry import parse_entries
from tidewell.functions.gate import gate
from tidewell.functions.html import LINK, base64_fields, cells, link_fields, pairs, rows, socks_scheme, textarea_words, web_scheme
from tidewell.functions.jsonrec import parse_strict, record_endpoints, unwrap
from tidewell.functions.text import bind, lines, tokens, trim_ws

RECORD_CAP = 100_000
BYTE_CAP = 32 << 20
BODY = ["provider_id", "ord", "seed_ix", "page_ix"]
KEYS = [*BODY, "default_scheme"]
RECORD = [*BODY, "rec_ix", "scheme", "host", "port", "user", "pass"]
# Names under which the web knows Windows-1252.
LATIN = {"ISO-8859-1", "LATIN1", "US-ASCII", "ASCII", "ISO8859-1"}


def charset_of(content_type: Column) -> Column:
    """The charset parameter of a content type, UTF-8 without one."""
    name = F.upper(F.regexp_extract(content_type, r"(?i)charset=[\"']?([^\"'; ]+)", 1))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("UTF-8"))


@F.pandas_udf(StringType())
def _other_charset(content: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, name):
        if raw is None:
            return None
        try:
            name = "cp1252" if name in LATIN else name
            return bytes(raw).decode(name, "replace")
        except LookupError:  # an unknown label counts as UTF-8
            return bytes(raw).decode("utf-8", "replace")

    return pd.Series([one(r, c) for r, c in zip(content, charset, strict=True)])


def decode_bodies(df: DataFrame, content: str = "content", content_type: str = "content_type") -> DataFrame:
    """Bytes to text by content type or byte order mark; bodies over the cap go. What is not valid becomes U+FFFD.
    UTF-8 stays in the JVM; other charsets pass through pandas, a batch at a time, as no JVM function replaces what it cannot decode."""
    d = df.filter(F.octet_length(content) <= BYTE_CAP).withColumn("_charset", charset_of(F.col(content_type)))
    mark = F.hex(F.substring(content, 1, 3))
    d = d.withColumn("_charset", F.when(mark == "EFBBBF", "UTF-8").when(F.startswith(mark, F.lit("FEFF")), "UTF-16BE").when(F.startswith(mark, F.lit("FFFE")), "UTF-16LE").otherwise(F.col("_charset")))
    plain = d.filter(F.col("_charset") == "UTF-8").withColumn("body", F.make_valid_utf8(F.col(content).cast("string")))
    other = d.filter(F.col("_charset") != "UTF-8").withColumn("body", _other_charset(content, "_charset"))
    whole = plain.unionByName(other)
    return whole.withColumn("body", F.regexp_replace("body", "^\\x{FEFF}", "")).drop("_charset")


def read_landed(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Bodies landed as Parquet; or, raw, a folder of files (one body each: path and content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content") if raw else spark.read.parquet(path)


def effective_kind(df: DataFrame) -> DataFrame:
    """``auto`` becomes json (valid object, or an array), ndjson (other object text) or entries."""
    lead = F.substring(trim_ws(F.col("body")), 1, 1)
    auto = F.when(lead == "[", "json").when(lead == "{", F.when(parse_strict(F.col("body")).isNotNull(), "json").otherwise("ndjson")).otherwise("entries")
    return bind(df, kind=F.when(F.col("parse_kind") == "auto", auto).otherwise(F.col("parse_kind")))


def entry_tokens(df: DataFrame, body: str = "body") -> DataFrame:
    """One row a token, with its place in the body."""
    every = F.flatten(F.transform(lines(F.col(body)), tokens))
    return df.select("*", F.posexplode(every).alias("rec_ix", "token"))


def ndjson_line(text: Column) -> Column:
    """Whether a line starts with a brace, white space aside, and is valid JSON."""
    return F.startswith(trim_ws(text), F.lit("{")) & parse_strict(text).isNotNull()


HTML_ROWS = ["link_rows", "base64_rows", "web_columns", "socks_columns"]


def pieces(d: DataFrame) -> DataFrame:
    """What line and HTML bodies consist of: rec_ix and piece (a token or a table row; of a pair the address, with its port)."""
    body, kind = F.col("body"), F.col("kind")
    plain = lambda xs: F.transform(xs, lambda x, i: F.struct(i.alias("rec_ix"), x.alias("piece"), F.lit(None).cast("string").alias("_pport")))
    every = (
        F.when(kind == "entries", plain(F.flatten(F.transform(lines(body), tokens))))
        .when(kind == "textarea", plain(textarea_words(body)))
        .when(kind.isin(HTML_ROWS), plain(rows(body)))
        .when(kind == "table_pairs", F.transform(pairs(body), lambda x, i: F.struct(i.alias("rec_ix"), x["h"].alias("piece"), x["p"].alias("_pport"))))
    )
    return d.select(*KEYS, "kind", F.inline(every))


def piece_records(d: DataFrame) -> DataFrame:
    """Raw records of line and HTML bodies; each kind reads its piece its own way."""
    kind, piece, default = F.col("kind"), F.col("piece"), F.col("default_scheme")
    d = bind(pieces(d), _token=F.when(kind.isin("entries", "textarea"), piece), _cells=F.when(kind.isin("web_columns", "socks_columns"), cells(piece)))
    d = parse_entries(d, "_token", "default_scheme")
    link, coded = link_fields(piece, default), base64_fields(piece, default)
    own = {
        "link_rows": [F.when(piece.rlike(LINK), x) for x in link],
        "base64_rows": coded,
        "table_pairs": [F.lit("http"), piece, F.col("_pport")],
        "web_columns": [web_scheme(F.col("_cells")), F.get("_cells", F.lit(0)), F.get("_cells", F.lit(1))],
        "socks_columns": [socks_scheme(F.col("_cells")), F.get("_cells", F.lit(0)), F.get("_cells", F.lit(1))],
    }
    chosen = {}
    for k, name in enumerate(("scheme", "host", "port")):
        value = F.when(F.col("_token").isNotNull(), F.col(name))
        for kind_name, fields in own.items():
            value = value.when(kind == kind_name, fields[k])
        chosen[name] = value
    return bind(d, **chosen).filter("host IS NOT NULL").select(*RECORD)


def json_records(d: DataFrame) -> DataFrame:
    """Raw records of JSON and NDJSON bodies; an invalid body or line has none."""
    whole = unwrap(d.withColumn("_json", F.when(F.col("kind") == "json", F.col("body"))), "_json")
    listed = F.when(F.col("kind") == "json", F.col("elements")).otherwise(F.transform(lines(F.col("body")), lambda x: F.struct(x.alias("text"), F.lit(False).alias("is_text"))))
    d = whole.select(*KEYS, "kind", F.posexplode(listed).alias("rec_ix", "e")).select(*KEYS, "kind", "rec_ix", F.col("e.text").alias("element"), F.col("e.is_text").alias("is_text"))
    # a line is parsed on its own; elements of a valid body are valid
    return record_endpoints(d.filter((F.col("kind") == "json") | ndjson_line(F.col("element")))).select(*RECORD)


def capped(records: DataFrame, body_keys: list[str], cap: int = RECORD_CAP) -> DataFrame:
    """The first ``cap`` records of each body, in order (records of one element by scheme)."""
    w = Window.partitionBy(*body_keys).orderBy("rec_ix", *[c for c in ("scheme",) if c in records.columns])
    return records.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def _valid(d: DataFrame) -> DataFrame:
    tabular, structured = d.filter(~F.col("kind").isin("json", "ndjson")), d.filter(F.col("kind").isin("json", "ndjson"))
    return gate(piece_records(tabular).unionByName(json_records(structured)))


def records(bodies: DataFrame, cap: int = RECORD_CAP) -> DataFrame:
    """Valid records of all bodies, in canonical form, with ``source`` (the provider) and ``url``; at most the cap of each body."""
    d = effective_kind(bodies.filter(trim_ws(F.col("body")) != ""))
    return capped(_valid(d), BODY, cap).withColumn("source", F.col("provider_id"))

