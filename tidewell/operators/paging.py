"""Pagination as declarative plans over landed pages.

Nothing loops: expected pages come from the declared total, and what stopped a chain is a classification
of its landed pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page size and the name of the total, by source.
PAGED = {"geonode": (500, "total"), "databay": (1000, "total"), "proxylister": (500, "count")}


def query_param(url: Column, name: str, last: bool = True) -> Column:
    """A decoded query parameter; of repeated ones the last (or the first)."""
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    own = F.filter(query, lambda p: F.substring_index(p, "=", 1) == name)
    at = F.element_at(own, -1 if last else 1)
    value = F.when(F.contains(at, F.lit("=")), F.regexp_replace(at, "^[^=]*=", "")).otherwise(F.lit(""))
    return F.when(F.size(own) > 0, F.try_url_decode(value))


def host_of(url: Column) -> Column:
    """The host, or the whole string."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def redacted(url: Column) -> Column:
    """Scheme, host and port only."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.when(authority != "", F.concat(F.substring_index(url, "://", 1), F.lit("://"), authority)).otherwise(F.lit("<invalid>"))


def last_page(total: Column, size: Column) -> Column:
    """Pages until ``page * size >= total``; the first page always exists."""
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("int")


def expected_pages(chains: DataFrame) -> DataFrame:
    """Chains with total, page_size and max_requests to one row for each page that should be fetched."""
    n = F.least(last_page(F.col("total"), F.col("page_size")), F.col("max_requests"))
    return chains.withColumn("last", last_page(F.col("total"), F.col("page_size"))).withColumn("page", F.explode(F.sequence(F.lit(1), n)))


def next_page(page: Column, total: Column, size: Column) -> Column:
    """G1: the page after this one, NULL when the source is exhausted."""
    return F.when(page * size < total, page + 1)


def stop_reasons(pages: DataFrame, chain: list[str], record_cap: int) -> DataFrame:
    """One row for each chain with what stopped it, in the order of the checks.

    Pages have page, ok, cancelled, late, panicked, n_records, advance_error, seen and has_next, and chains max_requests.
    """
    w = Window.partitionBy(*chain)
    last = pages.withColumn("_last", F.max("page").over(w)).filter("page = _last")
    reason = (
        F.when(~F.col("ok") & F.col("cancelled"), "harvest interrupted")
        .when(~F.col("ok") & F.col("late"), "provider time budget")
        .when(~F.col("ok"), "fetch failed")
        .when(F.col("panicked"), "parser panicked")
        .when(F.col("n_records") >= record_cap, "page record cap")
        .when(F.col("advance_error").isNotNull(), "truncated, not exhausted")
        .when(~F.col("has_next"), "exhausted")
        .when(F.col("seen"), "seen")
        .when(F.col("cancelled"), "harvest interrupted")
        .when(F.col("page") >= F.col("max_requests"), "stopped at max_requests")
        .when(F.col("late"), "provider time budget")
        .otherwise("missing page")
    )
    silent = F.col("reason").isin("exhausted", "seen")
    plain = F.col("reason").isin("fetch failed", "parser panicked")
    return last.withColumn("reason", reason).withColumn("truncated", ~silent & ~plain).withColumn("error", F.when(~silent, F.col("reason"))).drop("_last")


def unseen(next_urls: DataFrame, seen: DataFrame) -> DataFrame:
    """Follow-up URLs that their provider has not asked for, once each."""
    return next_urls.dropDuplicates(["provider_id", "url"]).join(seen.select("provider_id", "url"), ["provider_id", "url"], "left_anti")
