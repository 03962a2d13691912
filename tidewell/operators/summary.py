"""Per-source statistics, classification of a run, and its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 3


CAP_ERROR = "page record cap hit: truncated, not exhaustive"


def provider_runs(chains: DataFrame, records: DataFrame) -> DataFrame:
    """Chains to providers. Providers without a record keep their row; records count before merging.

    ``records`` has rows with provider_id, or counts by provider (``records``, and ``capped`` where a body hit the record cap:
    such a provider is truncated and has an error that says so).
    """
    own = chains.groupBy("provider_id").agg(
        F.sum("ok_requests").alias("ok_requests"),
        F.sum("total_requests").alias("total_requests"),
        F.max("duration_secs").alias("duration_secs"),
        F.bool_or("truncated").alias("truncated"),
        F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"),
    )
    if "capped" not in records.columns:
        return own.join(records.groupBy("provider_id").agg(F.count("*").alias("records")), "provider_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    joined = own.join(records.select("provider_id", "records", F.col("capped").alias("_capped")), "provider_id", "left")
    hit = F.coalesce("_capped", F.lit(False))
    errors = F.when(hit, F.array_sort(F.array_append("errors", F.lit(CAP_ERROR)))).otherwise(F.col("errors"))
    return joined.withColumns({"records": F.coalesce("records", F.lit(0)), "truncated": F.col("truncated") | hit, "errors": errors}).drop("_capped")


def outcome(total: Column, unique: Column, failures: Column, providers: Column, all_clean: Column) -> Column:
    """Failed without records; full if every provider is clean and no task failed; else partial."""
    return F.when((total == 0) | (unique == 0), "failed").when((failures == 0) & (providers > 0) & all_clean, "full").otherwise("partial")


def clean(ok_requests: Column, errors: Column, truncated: Column) -> Column:
    return (ok_requests > 0) & (F.size(errors) == 0) & ~truncated


def exit_code(label: Column) -> Column:
    """A9"""
    return F.when(label == "full", 0).when(label == "partial", 2).otherwise(1)


def run_outcome(runs: DataFrame, unique: Column, failures: Column) -> DataFrame:
    """A3, A4, A7, A9 over provider runs: one row."""
    one = runs.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records_total"), F.count("*").alias("providers"), F.coalesce(F.bool_and(clean(F.col("ok_requests"), F.col("errors"), F.col("truncated"))), F.lit(False)).alias("all_clean"))
    one = one.withColumn("records_unique", unique).withColumn("outcome", outcome(F.col("records_total"), F.col("records_unique"), failures, F.col("providers"), F.col("all_clean")))
    return one.withColumn("exit_code", exit_code(F.col("outcome"))).select("outcome", "exit_code", "records_total", "records_unique", "providers")


def error_sample(errors: Column) -> Column:
    """The first three errors, and how many more there are (a note also for none, from three on)."""
    more = F.size(errors) - SHOWN
    return F.array_join(F.concat(F.slice(errors, 1, SHOWN), F.when(more >= 0, F.array(F.format_string("+%d further", more))).otherwise(F.array().cast("array<string>"))), "; ")


def summary_document(runs: DataFrame, result: DataFrame, started_at: int, duration_secs: float) -> DataFrame:
    """The one-row summary; keys in order of name, none left out."""
    listed = runs.agg(F.array_sort(F.collect_list(F.struct("provider_id", "duration_secs", "errors", "ok_requests", "records", "total_requests", "truncated"))).alias("providers"))
    doc = result.drop("providers").crossJoin(listed)  # one row by one row
    return doc.select(F.to_json(F.struct(F.lit(float(duration_secs)).alias("duration_secs"), "exit_code", "outcome", "providers", "records_total", "records_unique", F.lit(int(started_at)).alias("started_at"))).alias("value"))


def provenance(pool: DataFrame, started_at: int) -> DataFrame:
    """One JSON line for each endpoint."""
    return pool.select(F.to_json(F.struct(F.col("url").alias("proxy"), F.lit(int(started_at)).alias("run_started_at"), "source")).alias("value"))
