"""Dates, delays and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
HTTP_DATE = r"^[A-Za-z]{3}, ([0-9]{2}) ([A-Z][a-z]{2}) ([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) GMT\z"


def http_date_seconds(c: Column) -> Column:
    """Epoch seconds of an IMF date. The weekday is ignored and days past a month's end roll over."""
    months = F.array(*map(F.lit, MONTHS))

    def seconds(p: Column) -> Column:
        number = lambda i: F.get(p, F.lit(i)).try_cast("int")
        day, month, year, h, m, s = number(0), F.array_position(months, F.get(p, F.lit(1))).cast("int"), number(2), number(3), number(4), number(5)
        ok = (month > 0) & day.between(1, 31) & (year >= 1000) & (h <= 23) & (m <= 59) & (s <= 59)
        days = F.datediff(F.date_add(F.make_date(F.when(ok, year), F.when(ok, month), F.lit(1)), day - 1), F.lit("1970-01-01").cast("date"))
        return F.when(ok, days.cast("bigint") * 86400 + h * 3600 + m * 60 + s)

    # the parts are bound by a lambda, so that they are split once a row
    parts = F.when(c.rlike(HTTP_DATE), F.array(F.split(F.substring(c, 6, 20), "[ :]")))
    return F.get(F.transform(parts, seconds), F.lit(0))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Whole seconds, or an HTTP date less ``now`` (0 at least), or 5; held to 1..120."""
    t = F.trim(header)
    whole = F.when(t.rlike(r"^\+?[0-9]+\z"), F.coalesce(t.try_cast("bigint"), F.lit(120)))
    # greatest skips NULLs, so a missing date is made 5 seconds by its own branch
    dated = F.coalesce(http_date_seconds(t) - now, F.lit(5))
    dated = F.when(dated < 0, F.lit(0)).otherwise(dated)
    return F.least(F.lit(120), F.greatest(F.lit(1), F.coalesce(whole, dated))).cast("bigint")


def rfc3339(ts: Column) -> Column:
    """T21, session time zone UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def jittered(delay: Column, seed: int) -> Column:
    """A delay times a uniform factor of [0.5, 1)."""
    return delay * (F.lit(0.5) + F.rand(seed) / 2)


def fetch_width(cpus: Column, memory_kb: Column, files: Column) -> Column:
    """How many fetches fit: 32 a core up to 256, by memory at 64 KB each, by open files less 512; 16 at least."""
    return F.greatest(F.lit(16), reduce(F.least, [cpus * 32, F.lit(256), F.floor(memory_kb / 64), files - 512]))
