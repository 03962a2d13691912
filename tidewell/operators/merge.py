"""First-wins merging of all sources, and the total order of the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scheme import ordinal

KEY = ["scheme", "host", "port", "user", "pass"]
ORDER = ["ord", "seed_ix", "page_ix", "rec_ix"]


def first_wins(records: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """One row for each endpoint, with the source that comes first in order.

    ``min_by`` combines on the map side, so a shuffle carries a row for each key and task at most, whatever
    the number of copies; null credentials are equal.
    """
    lead = F.struct(*order)
    return records.groupBy(*KEY, "url").agg(F.min_by("source", lead).alias("source"))


def per_body(records: DataFrame) -> DataFrame:
    """One row for each endpoint and body, with its copies and its first place: a hash aggregate, for it only keeps numbers."""
    return records.groupBy(*KEY, "url", "source", "provider_id", "ord", "seed_ix", "page_ix").agg(F.min("rec_ix").alias("rec_ix"), F.count("*").alias("copies"))


def pool_order(pool: DataFrame) -> DataFrame:
    """O1: scheme ordinal, host bytes, port number, user and password with nulls first."""
    return pool.orderBy(ordinal(F.col("scheme")), "host", "port", F.col("user").asc_nulls_first(), F.col("pass").asc_nulls_first())


def scheme_counts(pool: DataFrame) -> DataFrame:
    """A10: one row with a count for each of the four schemes, zeros included."""
    from tidewell.functions.scheme import SCHEMES

    return pool.agg(*[F.count_if(F.col("scheme") == s).alias(s) for s in SCHEMES])
