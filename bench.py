"""Times the engine's queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

BENCH_DUCKDB=1 also times the SQL that states the same rows in DuckDB, with as many threads, under `duckdb`.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalogue
from tidemark.session import session

HEADLINE = ["daily_counts", "intensity", "temporal_metrics", "naive_score", "factor_features", "exact_mentions", "lexical_candidates", "precedence_dedupe", "alias_bootstrap", "unigram_entropy", "centroid_topk", "similarity_stats", "drift_windows", "drift_summary", "adjudicate", "consistency_audit", "column_profile", "regression_design", "topk_per_entity", "clean_body", "adversarial_norm"]


def duckdb_seconds(sf_dir: str, threads: int) -> dict[str, float]:
    """Seconds of one run each, after one that warms up."""
    import duckdb

    db = duckdb.connect(config={"threads": threads})
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}{'/*' if os.path.isdir(f'{sf_dir}/{name}') else ''}'")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            db.execute(catalogue.ORACLE_SQL[name]).fetchall()
            took[name] = round(time.time() - began, 4)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + repeats):  # the first run warms up and is not counted
            began = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(sorted(runs[1:])[len(runs[1:]) // 2], 4)
    more = {"duckdb": duckdb_seconds(sf_dir, int(cpus))} if os.environ.get("BENCH_DUCKDB") == "1" else {}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1]} | more))
    spark.stop()


if __name__ == "__main__":
    main()
