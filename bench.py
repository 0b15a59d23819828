"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from cinnabar import queries as q
from cinnabar.operators import bindings as b
from cinnabar.operators.evaluate import evaluate, evaluate_by_rows
from cinnabar.operators.staging import stage

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
#: After so many seconds the queries that have not run are left out, and what was measured is printed.
LIMIT = float(os.environ.get("BENCH_LIMIT", "200"))
HEADLINES = ["scan_facts", "join_single_key", "join_multi_key", "extend_bindings", "semi_join", "anti_join", "coverage_chain", "self_join", "count_single_literal", "eval_candidates", "rule_metrics", "theory_coverage", "uncovered_after_rule", "radix_histogram", "learned_rules"]


def factorised(spark: SparkSession, sf: str):
    """One literal-search iteration: all second candidates over the lines of orders, counted by keys."""
    r = q.relations(spark, sf)
    rows = stage(b.extend(q.hot_orders(spark, sf), q.literal("line(0, -1, -1)"), r), "bench")
    return evaluate(rows, SECOND, r)


def by_rows(spark: SparkSession, sf: str):
    """The same counts from exploded joins, literal by literal."""
    r = q.relations(spark, sf)
    rows = stage(b.extend(q.hot_orders(spark, sf), q.literal("line(0, -1, -1)"), r), "bench")
    out = None
    for x in SECOND:
        one = evaluate_by_rows(rows, x, r)
        out = one if out is None else out.unionByName(one)
    return out


SECOND = [q.literal(t) for t in ("line(0, -1, -1)", "line(-1, 2, -1)", "line(-1, -1, 3)", "line(0, 2, -1)", "line(0, -1, 3)", "placed(0, -1)", "placed(-1, 1)", "supp_nation(3, -1)", "urgent(0)", "building(1)")]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(max(8, int(CPUS))))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: q.QUERIES[n] for n in HEADLINES} | {"iteration_factorised": factorised, "iteration_by_rows": by_rows}
    seconds = {}
    start = time.monotonic()
    for name, f in todo.items():
        times = []
        for _ in range(RUNS + 1):  # the first warms up, and counts only if there is no time for more
            if time.monotonic() - start > LIMIT:
                break
            began = time.monotonic()
            f(spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.monotonic() - began)
        if times:
            seconds[name] = round(median(times[1:] or times), 3)
    total = sum(v for k, v in seconds.items() if k != "iteration_by_rows")
    print(json.dumps({"metric": "engine_queries_total", "value": round(total, 3), "unit": "sec", "queries": seconds, "left_out": [n for n in todo if n not in seconds], "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
