"""F8: scheme labels and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import lower_ascii, trim_ws

SCHEMES = ["http", "https", "socks4", "socks5"]
# Label to canonical scheme.
LABELS = {
    "http": "http",
    "https": "https",
    "ssl": "https",
    "socks4": "socks4",
    "socks4a": "socks4",
    "socks": "socks5",
    "socks5": "socks5",
    "socks5h": "socks5",
}


def canon(label: Column) -> Column:
    """The canonical scheme of a label, or NULL."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.try_element_at(known, lower_ascii(trim_ws(label)))


def ordinal(scheme: Column) -> Column:
    """0..3 in declaration order."""
    return (F.array_position(F.array(*map(F.lit, SCHEMES)), scheme) - 1).cast("int")


def ordered(schemes: Column) -> Column:
    """Distinct schemes in declaration order."""
    return F.filter(F.array(*map(F.lit, SCHEMES)), lambda s: F.array_contains(schemes, s))
