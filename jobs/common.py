"""What the jobs share: configuration, session, logging."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str | None, known: dict) -> dict:
    """The settings of a JSON file, which can be anywhere that Spark reads, over the defaults. A name that is not known is an error."""
    own = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if strange := sorted(own.keys() - known.keys()):
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    return known | own


def write_counted(rows: DataFrame, path: str, partitions: list[str], dynamic: bool = False) -> int:
    """Write Parquet over what is there (only the partitions that rows have, if ``dynamic``); the number of rows, counted on the way."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*partitions).parquet(path)
    return seen.get["rows"]


def main(name: str, text: str, paths: list[str], run: Callable[..., dict]) -> None:
    """Command line of a job: path arguments and --config. Exit 0: done, 1: done and the result was refused."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=text)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file with settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        found = run(spark, *(getattr(args, p) for p in paths), args.config)
    finally:
        spark.stop()
    sys.exit(1 if found.get("violations") else 0)
