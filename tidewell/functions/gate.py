"""the one gate that every candidate passes, whatever its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.hosts import with_host
from tidewell.functions.text import bind, trim_ws

CLEAN = r"^[^\p{Cc}\p{IsWhite_Space}#?%@/\\]+\z"


def port_number(text: Column) -> Column:
    """1..65535 from digits with an optional plus sign and leading zeros, else NULL."""
    t = trim_ws(text)
    n = F.when(t.rlike(r"^\+?[0-9]+\z"), t.try_cast("int"))
    return F.when(n.between(1, 65535), n)


def clean_credential(c: Column) -> Column:
    """not empty, no control, no white space, none of ``# ? % @ / \\``."""
    return c.rlike(CLEAN)


def credentials_ok(user: Column, password: Column) -> Column:
    """F1 for credentials: absent is fine, empty is not; a password needs a user; no colon in a user."""
    user_ok = user.isNull() | (clean_credential(user) & ~F.contains(user, F.lit(":")))
    pass_ok = password.isNull() | (clean_credential(password) & user.isNotNull())
    return user_ok & pass_ok


def gate(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """rows with raw scheme, host, port, user, pass keep only what is valid, in canonical form.

    ``scheme`` must be canonical already or NULL (rejected). Adds nothing but ``url``.
    """
    checked = bind(with_host(df, "host", "_host", ipv6), _port=port_number(F.col("port")))
    ok = F.col("scheme").isNotNull() & F.col("_host").isNotNull() & F.col("_port").isNotNull() & credentials_ok(F.col("user"), F.col("pass"))
    kept = checked.filter(ok).withColumn("host", F.col("_host")).withColumn("port", F.col("_port")).drop("_host", "_port")
    return kept.withColumn("url", url())


def url() -> Column:
    """scheme://[user[:pass]@]host:port"""
    user = F.coalesce(F.concat("user", F.coalesce(F.concat(F.lit(":"), "pass"), F.lit("")), F.lit("@")), F.lit(""))
    return F.concat("scheme", F.lit("://"), user, "host", F.lit(":"), F.col("port").cast("string"))
