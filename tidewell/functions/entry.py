"""One entry token to raw endpoint fields, as staged column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scheme import canon
from tidewell.functions.text import WS, after_last, before_last, bind, trim_ws

FIELDS = ["scheme", "host", "port", "user", "pass"]


def bare_token(token):
    """Trimmed, and without quotes and backticks at both ends."""
    return F.btrim(trim_ws(token), F.lit('"`'))


def skipped(token):
    """blank, or a comment or markup line; one match on the raw token, equal to testing the bare one."""
    return token.rlike(rf'^{WS}*["`]*(?:[#<>%!|]|{WS}*\z)')


def parse_entries(df: DataFrame, token: str, default: str, prefix: str = "") -> DataFrame:
    """Adds raw scheme, host, port, user and pass of a token; host is NULL for a rejected token.

    Values are not validated here: that is the gate's work.
    """
    t = F.col("_t")
    d = bind(df, _t=bare_token(F.col(token)))
    has = F.contains(t, F.lit("://"))
    d = bind(
        d,
        _has=has,
        _ok=(t != "") & ~t.rlike(r"^[#<>%!|]"),
        _declared=F.when(has, canon(F.substring_index(t, "://", 1))),
        _r0=F.when(has, F.regexp_replace(F.expr("substring(_t, instr(_t, '://') + 3)"), r"/+\z", "")).otherwise(t),
    )
    auth = F.contains("_r0", F.lit("@"))
    d = bind(
        d,
        _ok=F.col("_ok") & (~F.col("_has") | F.col("_declared").isNotNull()),
        _creds=F.when(auth, before_last(F.col("_r0"), "@")),
        _r=F.when(auth, after_last(F.col("_r0"), "@")).otherwise(F.col("_r0")),
    )
    parts = F.split("_r", ":", -1)
    d = bind(
        d,
        _ok=F.col("_ok") & (F.col("_creds").isNull() | (F.col("_creds") != "")),
        _user=F.substring_index("_creds", ":", 1),
        _pass=F.when(F.contains("_creds", F.lit(":")), F.expr("substring(_creds, instr(_creds, ':') + 1)")),
        _v6=F.contains("_r", F.lit("]:")),
        _p=parts,
        _n=F.size(parts),
        _last=after_last(F.col("_r"), ":"),
    )
    part = lambda i: F.get("_p", F.lit(i))
    digits = r"^[0-9]+\z"
    four = ~F.col("_v6") & (F.col("_n") == 4)
    long = ~F.col("_v6") & (F.col("_n") > 4)
    shaped = (
        F.when(F.col("_v6"), F.startswith("_r", F.lit("[")))
        .when(F.col("_n") == 2, F.lit(True))
        .when(F.col("_n") == 3, ~part(2).rlike(digits))
        .when(F.col("_n") == 4, F.col("_user").isNull())
        .when(F.col("_n") > 4, F.col("_last").rlike(digits))
        .otherwise(F.lit(False))
    )
    host = F.when(F.col("_v6"), F.concat(before_last(F.col("_r"), "]:"), F.lit("]"))).when(long, before_last(F.col("_r"), ":")).otherwise(part(0))
    port = F.when(F.col("_v6"), after_last(F.col("_r"), "]:")).when(long, F.col("_last")).otherwise(part(1))
    override = F.when(~F.col("_v6") & (F.col("_n") == 3), canon(part(2)))
    values = {
        "scheme": F.coalesce(override, "_declared", F.col(default)),
        "host": F.when(F.coalesce(F.col("_ok") & shaped, F.lit(False)), host),
        "port": port,
        "user": F.when(four, part(2)).otherwise(F.col("_user")),
        "pass": F.when(four, part(3)).otherwise(F.col("_pass")),
    }
    d = bind(d, **{f"{prefix}{k}": v for k, v in values.items()})
    return d.drop("_t", "_has", "_ok", "_declared", "_r0", "_creds", "_r", "_user", "_pass", "_v6", "_p", "_n", "_last")
