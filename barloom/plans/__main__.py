"""``python -m barloom.plans ingest|build --settings FILE …``: the jobs from the command line."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from barloom.functions.caltime import parse_cli_timestamp
from barloom.operators.periods import load_settings
from barloom.plans.build import build
from barloom.plans.ingest import fetch
from barloom.schema import DERIVED, Timeframe
from barloom.sources.bar_source import SideFiles
from barloom.sources.lake import Lake
from barloom.sources.meta import Meta


def _time(text: str) -> datetime:
    return parse_cli_timestamp(text).replace(tzinfo=timezone.utc)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a job; returns its exit code. What a user can mend (settings, options, locked or faulty data) ends in a message and code 1."""
    try:
        return _main(args, spark)
    except (ValueError, KeyError, PermissionError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _main(args: list[str] | None, spark: SparkSession | None) -> int:
    p = argparse.ArgumentParser(prog="barloom.plans")
    p.add_argument("--settings", required=True)
    jobs = p.add_subparsers(dest="job", required=True)
    ingest = jobs.add_parser("ingest", help="fetch what is missing from files of sides")
    ingest.add_argument("--source", required=True)
    ingest.add_argument("--start", type=_time)
    ingest.add_argument("--end", type=_time, default=datetime.now(timezone.utc).replace(second=0, microsecond=0))
    ingest.add_argument("--chunk-days", type=int, default=30)
    make = jobs.add_parser("build", help="rebuild derived time frames")
    make.add_argument("--timeframe", action="append", choices=[t.value for t in DERIVED])
    make.add_argument("--as-of", type=_time, default=datetime.now(timezone.utc))
    a = p.parse_args(args)
    settings = load_settings(a.settings)
    spark = spark or SparkSession.builder.appName("barloom").getOrCreate()
    lake, meta = Lake(spark, settings.data_root), Meta(spark, settings.meta_path)
    if a.job == "build":
        for name, row in build(settings, lake, as_of=a.as_of, meta=meta, timeframes=tuple(map(Timeframe, a.timeframe or [t.value for t in DERIVED]))).items():
            print(name, row)
        return 0
    start = a.start or settings.data_start.replace(tzinfo=timezone.utc)
    out = fetch(SideFiles(spark, a.source, (settings.symbol,)), lake, meta, settings.symbol, start, a.end, chunk_days=a.chunk_days)
    print(out)
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main())
