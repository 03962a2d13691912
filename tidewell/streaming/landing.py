"""Continuously landing bodies as a structured stream: parse, gate, and endpoints in event-time windows.

Arrival order is not registry order, so attribution within a window goes by the order columns, as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.entry import parse_entries
from tidewell.functions.gate import gate
from tidewell.sources.bodies import entry_tokens

BODY = "provider_id string, ord int, seed_ix int, page_ix int, default_scheme string, body string, landed_at timestamp"


def landed(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(BODY).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def endpoints(bodies: DataFrame) -> DataFrame:
    """Valid endpoints of line bodies; narrow, so it streams without state."""
    return gate(parse_entries(entry_tokens(bodies), "token", "default_scheme")).withColumn("source", F.col("provider_id"))


def first_seen(bodies: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Endpoints of each event-time window with the source that comes first in registry order; late bodies within the
    watermark count."""
    rows = endpoints(bodies.withWatermark("landed_at", late))
    lead = F.struct("ord", "seed_ix", "page_ix", "rec_ix")
    return rows.groupBy(F.window("landed_at", window), "scheme", "host", "port", "user", "pass", "url").agg(F.min_by("source", lead).alias("source"), F.count("*").alias("seen"))


def distinct_endpoints(bodies: DataFrame, late: str = "1 hour") -> DataFrame:
    """Endpoints at their first arrival within the watermark."""
    return endpoints(bodies.withWatermark("landed_at", late)).dropDuplicatesWithinWatermark(["url"])
