"""Command line: ``python -m tidewell --bodies DIR --chains DIR -o proxies.txt``.

Exit status: 0 full, 2 partial (also for wrong arguments), 1 failed.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from tidewell.harvest import harvest
from tidewell.sources.registry import check_integrity, listing, providers

log = logging.getLogger("tidewell")


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidewell")
    p.add_argument("-o", "--output", default="proxies.txt", help="pool file; provenance and summary go beside it")
    p.add_argument("--bodies", help="landed bodies (Parquet)")
    p.add_argument("--chains", help="statistics of the fetched chains (Parquet)")
    p.add_argument("--providers", help="ids, comma-separated, in order of precedence")
    p.add_argument("--list-providers", action="store_true")
    p.add_argument("--partitions", type=positive, help="shuffle partitions")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    args = p.parse_args(argv)
    if not args.list_providers and not (args.bodies and args.chains):
        p.error("--bodies and --chains are needed")
    return args


def level(verbose: bool, quiet: bool) -> int:
    """Verbose wins over quiet."""
    return logging.DEBUG if verbose else logging.WARNING if quiet else logging.INFO


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=level(args.verbose, args.quiet), format="%(levelname).1s %(asctime)s %(name)s: %(message)s")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.partitions))
    registry = providers(spark)
    if not check_integrity(registry).isEmpty():
        log.error("the registry has empty or repeated ids")
        return 2
    if args.list_providers:
        for row in listing(registry).select("line").collect():  # a few dozen rows
            print(row["line"])
        return 0
    ids = [i.strip() for i in args.providers.split(",") if i.strip()] if args.providers else None
    try:
        result = harvest(spark.read.parquet(args.bodies), spark.read.parquet(args.chains), args.output, provider_ids=ids)
    except ValueError as error:
        log.error("%s", error)
        return 2
    log.info("%s: %d records, %d endpoints in %s", result.outcome, result.records_total, result.records_unique, result.paths.pool)
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
