"""Hosts and addresses, JVM-side.

IPv4 is a BIGINT; IPv6 does not fit any numeric type and is a string of 32 hex digits, whose order is the
numeric order. Range tests are literal comparisons, so they fold into one code-generated predicate.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import bind, lower_ascii, trim_ws

# Address ranges that are no public hosts, and the exceptions inside them.
V4_PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]
V4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
V4_MULTICAST = "224.0.0.0/4"
V6_PRIVATE = ["::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10"]
V6_EXCEPTIONS = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
V6_RESERVED = ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"]
V6_MULTICAST = "ff00::/8"

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^(?:{OCTET}\.){{3}}{OCTET}\z"
LABEL = "[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?"
HOSTNAME = rf"^{LABEL}(?:\.{LABEL})+\z"


def bounds4(cidr: str) -> tuple[int, int]:
    net = ipaddress.IPv4Network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def bounds6(cidr: str) -> tuple[str, str]:
    net = ipaddress.IPv6Network(cidr)
    return f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"


def _within(c: Column, bounds) -> Column:
    return reduce(Column.__or__, [c.between(F.lit(lo), F.lit(hi)) for lo, hi in bounds])


def ipv4_number(text: Column) -> Column:
    """The number of a strict dotted quad, else NULL."""
    p = F.split(text, r"\.")
    n = lambda i: F.element_at(p, i).cast("bigint")
    return F.when(text.rlike(IPV4), n(1) * 16777216 + n(2) * 65536 + n(3) * 256 + n(4))


def ipv4_text(n: Column) -> Column:
    return F.concat_ws(".", F.shiftright(n, 24), F.shiftright(n, 16).bitwiseAND(255), F.shiftright(n, 8).bitwiseAND(255), n.bitwiseAND(255))


def v4_unusable(n: Column) -> Column:
    """F5 for IPv4 numbers."""
    return (_within(n, map(bounds4, V4_PRIVATE)) & ~_within(n, map(bounds4, V4_EXCEPTIONS))) | _within(n, [bounds4(V4_MULTICAST)])


def v6_unusable(hex32: Column) -> Column:
    """F5 for IPv6 as 32 hex digits; mapped addresses follow their IPv4 part."""
    mapped = F.conv(F.substring(hex32, 25, 8), 16, 10).cast("bigint")
    own = (_within(hex32, map(bounds6, V6_PRIVATE)) & ~_within(hex32, map(bounds6, V6_EXCEPTIONS))) | _within(hex32, map(bounds6, V6_RESERVED)) | _within(hex32, [bounds6(V6_MULTICAST)])
    return F.when(F.substring(hex32, 1, 24) == "0" * 20 + "ffff", v4_unusable(mapped)).otherwise(own)


def with_ipv6(df: DataFrame, text: Column, hex32: str, canon: str) -> DataFrame:
    """Adds the 32 hex digits and the canonical (compressed) text of an IPv6 text, NULL if it is none."""
    group = "[0-9a-f]{1,4}"
    some = rf"^(?:{group}(?::{group})*)?\z"
    size = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, ":")))
    df = bind(df, _v6=lower_ascii(text))
    df = bind(df, _tail4=F.regexp_extract("_v6", r"^[0-9a-f:]*:([0-9.]+)\z", 1))
    n4 = ipv4_number(F.col("_tail4"))
    low = F.concat(F.lower(F.hex(F.shiftright(n4, 16))), F.lit(":"), F.lower(F.hex(n4.bitwiseAND(65535))))
    df = bind(df, _v6=F.when(F.contains("_v6", F.lit(".")), F.concat(F.left("_v6", F.length("_v6") - F.length("_tail4")), low)).otherwise(F.col("_v6")))
    df = bind(df, _head=F.substring_index("_v6", "::", 1), _rest=F.when(F.contains("_v6", F.lit("::")), F.expr("substring(_v6, instr(_v6, '::') + 2)")))
    short = F.col("_rest").isNotNull() & F.col("_head").rlike(some) & F.col("_rest").rlike(some) & (size(F.col("_head")) + size(F.col("_rest")) <= 7)
    full = F.col("_rest").isNull() & F.col("_v6").rlike(rf"^(?:{group}:){{7}}{group}\z")
    parts = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))
    groups = F.when(full, F.split("_v6", ":")).when(short, F.concat(parts(F.col("_head")), F.array_repeat(F.lit("0"), 8 - size(F.col("_head")) - size(F.col("_rest"))), parts(F.col("_rest"))))
    df = bind(df, _groups=groups)
    df = bind(df, **{hex32: F.array_join(F.transform("_groups", lambda g: F.lpad(g, 4, "0")), "")}, _plain=F.array_join(F.transform("_groups", lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0"))), ":"))
    # the longest run of two zero groups or more, the first of equals
    x = "concat(':', _plain, ':')"
    longest = F.array_max(F.transform(F.regexp_extract_all(F.expr(x), F.lit("(?::0)+(?=:)"), F.lit(0)), lambda r: F.length(r)))
    df = bind(df, _run=F.when(longest >= 4, F.concat(F.repeat(F.lit(":0"), (longest / 2).cast("int")), F.lit(":"))))
    at = f"instr({x}, _run)"
    compressed = F.when(F.col("_run").isNotNull(), F.expr(f"concat(substring({x}, 2, {at} - 2), '::', substring({x}, {at} + length(_run), greatest(0, length({x}) - {at} - length(_run))))"))
    mapped = F.concat(F.lit("::ffff:"), ipv4_text(F.conv(F.substring(hex32, 25, 8), 16, 10).cast("bigint")))
    df = bind(df, **{canon: F.when(F.substring(hex32, 1, 24) == "0" * 20 + "ffff", mapped).otherwise(F.coalesce(compressed, "_plain"))})
    return df.drop("_v6", "_tail4", "_head", "_rest", "_groups", "_plain", "_run")


def valid_hostname(name: Column) -> Column:
    """253 bytes, a dot, labels of 1 to 63 word characters and inner hyphens."""
    return (F.octet_length(name) <= 253) & name.rlike(HOSTNAME)


def with_host(df: DataFrame, source: str, out: str, ipv6: bool = True) -> DataFrame:
    """adds the canonical host of a text column, NULL where it is not acceptable."""
    df = bind(df, _h=trim_ws(F.regexp_replace(trim_ws(F.col(source)), r"\.+\z", "")))
    bracketed = F.col("_h").rlike(r"(?s)^\[.*\]\z")
    df = bind(df, _inner=F.when(bracketed, F.expr("substring(_h, 2, length(_h) - 2)")).otherwise(F.col("_h")), _b=bracketed)
    df = bind(df, _ip4=ipv4_number(F.col("_inner")))
    if ipv6:
        df = with_ipv6(df, F.when(F.contains("_inner", F.lit(":")), F.col("_inner")), "_hex", "_canon6")
    else:
        df = df.withColumn("_hex", F.lit(None).cast("string")).withColumn("_canon6", F.lit(None).cast("string"))
    name = lower_ascii(F.col("_h"))
    host = (
        F.when(F.col("_ip4").isNotNull(), F.when(~v4_unusable(F.col("_ip4")), F.when(F.col("_b"), F.concat(F.lit("["), "_inner", F.lit("]"))).otherwise(F.col("_inner"))))
        .when(F.col("_hex").isNotNull(), F.when(~v6_unusable(F.col("_hex")), F.concat(F.lit("["), "_canon6", F.lit("]"))))
        .when(F.col("_b") | F.contains("_h", F.lit(":")), F.lit(None))
        .when(valid_hostname(name), name)
    )
    return bind(df, **{out: host}).drop("_h", "_inner", "_b", "_ip4", "_hex", "_canon6")
