"""Queries over a log of fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import trim_ws

# Statuses that are tried again (0: no answer).
RETRY = [0, 408, 425, 429, 500, 502, 503, 504]
BREAKER = 8
BYTE_CAP = 32 << 20


def declared_oversize(length: Column) -> Column:
    """a declared length over the cap; garbage and absence are not."""
    return F.coalesce(F.when(length.rlike(r"^\+?[0-9]+\z"), length.cast("decimal(38,0)") > BYTE_CAP), F.lit(False))


def valid_etag(etag: Column) -> Column:
    """visible ASCII, not empty."""
    return F.coalesce(etag.rlike(r"^[\x21-\x7E]+\z"), F.lit(False))


def usable_cache(cache: DataFrame) -> DataFrame:
    """Cache rows with a valid etag (white space around it does not count) and a body that is not blank."""
    return cache.withColumn("etag", trim_ws(F.col("etag"))).filter(valid_etag(F.col("etag")) & (trim_ws(F.col("body")) != ""))


def status_class(status: Column, blank: Column, cached: Column) -> Column:
    """Hit, ok, limited, retry or permanent; a blank 200 is retried."""
    return F.when((status == 304) & cached, "hit").when((status == 200) & ~blank, "ok").when(status == 429, "limited").when(status.isin(RETRY) | (status == 200), "retry").otherwise("permanent")


def trips_breaker(connect: Column, proxy: Column, dns: Column, tls: Column) -> Column:
    """connection-phase failures trip the breaker; a timeout alone does not."""
    return connect | proxy | dns | tls


def resolve_304(log: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached body stands in for a 304's."""
    c = usable_cache(cache).select("url", F.col("body").alias("_cached"))
    return log.join(c, "url", "left").withColumn("cached", (F.col("status") == 304) & F.col("_cached").isNotNull()).withColumn("body", F.when(F.col("status") == 304, F.col("_cached")).otherwise(F.col("body"))).drop("_cached")


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by URL; the new row wins, of several the one with the smallest etag and body."""
    both = usable_cache(new).withColumn("_p", F.lit(0)).unionByName(usable_cache(old).withColumn("_p", F.lit(1)))
    return both.groupBy("url").agg(F.min(F.struct("_p", "etag", "body")).alias("_b")).select("url", "_b.etag", "_b.body")


def breaker(log: DataFrame, host: str, order: list[str], threshold: int = BREAKER) -> DataFrame:
    """Running streak of connection failures of a host and whether its breaker has tripped, for good.

    The log has ``success`` and ``connect_failure``; another failure neither adds to the streak nor ends it.
    One host's rows are a window partition; a log with a hot host is cut by day first.
    """
    upto = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = log.withColumn("island", F.sum(F.col("success").cast("int")).over(upto))
    within = Window.partitionBy(host, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    streak = island.withColumn("streak", F.sum(F.col("connect_failure").cast("int")).over(within))
    return streak.withColumn("tripped", F.max(F.col("streak") >= threshold).over(upto)).drop("island")


def attempts(log: DataFrame) -> DataFrame:
    """Tries of each URL, and the last status."""
    return log.groupBy("url").agg(F.count("*").alias("tries"), F.count_if(F.col("status") == 429).alias("limited"), F.max(F.struct("ts", "status"))["status"].alias("last_status"))
