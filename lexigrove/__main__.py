"""python -m lexigrove [--data FOLDER] [--out FOLDER] [--pipeline auto|cpu|gpu|lexical] [--n-candidates N] [--lemmas CSV] [--models FOLDER] [--lock FILE]

The data folder holds regulations.jsonl, declarations.jsonl and tnved_knowledge.txt; the output folder gets predictions.csv.
Exit 0: written and valid; 1: the gate refuses it; 2: an input, a model or a GPU is missing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.artifacts import executors_have_gpu
from .plans.run import DECLARATIONS, DUMP, PREDICTIONS, REGULATIONS, choose, run


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexigrove")
    parser.add_argument("--data", default="./data")
    parser.add_argument("--out", default="./out")
    parser.add_argument("--pipeline", default="auto", choices=["auto", "cpu", "gpu", "lexical"])
    parser.add_argument("--n-candidates", type=int)
    parser.add_argument("--lemmas")
    parser.add_argument("--models", default="./models")
    parser.add_argument("--lock", default="./model_lock.json")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lexigrove").getOrCreate()
    paths = [f"{given.data.rstrip('/')}/{name}" for name in (REGULATIONS, DECLARATIONS, DUMP)]
    try:
        config = choose(given.pipeline, executors_have_gpu(spark), given.n_candidates)
        wrong = run(spark, *paths, f"{given.out.rstrip('/')}/{PREDICTIONS}", config, lemmas=given.lemmas, lock_file=given.lock, models=given.models)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for row in wrong:
        print(*row, file=sys.stderr)
    return 1 if wrong else 0


if __name__ == "__main__":
    sys.exit(main())
