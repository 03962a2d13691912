"""The whole run over landed bodies: parse, merge, classify, commit."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.merge import first_wins, per_body
from tidewell.operators.summary import provider_runs, run_outcome, summary_document
from tidewell.sources.bodies import BODY, RECORD_CAP, records
from tidewell.sources.registry import providers
from tidewell.sources.sinks import ArtifactPaths, write_artifacts


@dataclass(frozen=True)
class RunResult:
    outcome: str
    exit_code: int
    records_total: int
    records_unique: int
    paths: ArtifactPaths


def chosen(bodies: DataFrame, chains: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """the rows of the named sources; their order in the list, first mentions, becomes the precedence."""
    spark = bodies.sparkSession
    known = {r["id"] for r in providers(spark).select("id").collect()}
    unknown = [i for i in dict.fromkeys(ids) if i not in known]
    if unknown:
        raise ValueError(f"unknown providers: {', '.join(unknown)}")
    order = F.broadcast(spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "provider_id string, _ord int"))
    own = bodies.join(order, "provider_id").withColumn("ord", F.col("_ord")).drop("_ord")
    return own.select(*bodies.columns), chains.join(order.select("provider_id"), "provider_id", "left_semi")


def harvest(bodies: DataFrame, chains: DataFrame, output: str = "proxies.txt", started_at: int | None = None, task_failures: int = 0, provider_ids: list[str] | None = None) -> RunResult:
    """Bodies and chain statistics to the three files.

    The bodies are parsed once, to a row for each endpoint, source and body; the pool, its two sinks, the counts of the
    providers and the bodies that hit the record cap all come from that.
    """
    if provider_ids is not None:
        bodies, chains = chosen(bodies, chains, provider_ids)
    began = time.time()
    started_at = int(began) if started_at is None else started_at
    once = per_body(records(bodies)).persist(StorageLevel.MEMORY_AND_DISK)
    pool = first_wins(once).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        unique = pool.count()
        counted = once.groupBy(*BODY).agg(F.sum("copies").alias("records"))
        by_provider = counted.groupBy("provider_id").agg(F.sum("records").alias("records"), F.max(F.col("records") >= RECORD_CAP).alias("capped"))
        runs = provider_runs(chains, by_provider).persist()
        result = run_outcome(runs, F.lit(unique), F.lit(task_failures))
        one = result.first()
        took = time.time() - began
        failed = summary_document(runs, result.withColumns({"outcome": F.lit("failed"), "exit_code": F.lit(1)}), started_at, took).first()[0]
        paths = write_artifacts(pool, summary_document(runs, result, started_at, took), one["outcome"], output, started_at, failed_summary=failed)
        return RunResult(one["outcome"], one["exit_code"], one["records_total"], one["records_unique"], paths)
    finally:
        pool.unpersist()
        once.unpersist()
