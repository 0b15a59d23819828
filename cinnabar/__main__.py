"""python -m cinnabar catalog.json [--summary] [--minimum-f-score 0.9 ...]: learn rules and report them.

--summary also writes a tab-separated row to standard error.  Every field of LearnerConfig is an option.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession

from cinnabar.operators.evaluate import label_counts
from cinnabar.plans.learner import LearnerConfig
from cinnabar.sources import report
from cinnabar.sources.catalog import Catalog


def options(args: list[str] | None = None) -> tuple[argparse.Namespace, LearnerConfig]:
    parser = argparse.ArgumentParser(prog="cinnabar", description=__doc__)
    parser.add_argument("catalog")
    parser.add_argument("--summary", action="store_true")
    default = LearnerConfig()
    for f in dataclasses.fields(LearnerConfig):
        value = getattr(default, f.name)
        kind = {"run_tests": lambda x: x.lower() in ("1", "true", "yes"), "memory_quota": int}.get(f.name, type(value))
        parser.add_argument("--" + f.name.replace("_", "-"), type=kind, default=value)
    got = parser.parse_args(args)
    return got, LearnerConfig(**{f.name: getattr(got, f.name) for f in dataclasses.fields(LearnerConfig)})


def main(args: list[str] | None = None) -> None:
    got, config = options(args)
    spark = SparkSession.builder.appName("cinnabar").getOrCreate()
    catalog = Catalog.load(got.catalog)
    learned, metrics = catalog.learn(spark, config)
    print("\n".join(report.lines(learned, metrics)))
    if got.summary:
        print(report.summary_row(*label_counts(catalog.examples(spark)), learned, metrics), file=sys.stderr)


if __name__ == "__main__":
    main()
