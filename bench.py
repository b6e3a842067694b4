"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Each query runs twice into
the no-op sink; the warm time counts and the first run is given as ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flux_series",
    "supply_flux_series",
    "ensemble_state_by_window",
    "transition_counts_whole_nine_states",
    "changeyness_for_many_widths",
    "rolling_flux_fifteen_rows",
    "trailing_flux",
    "debounced_new_ideas",
    "features_tumbling",
    "features_rolling",
    "training_set",
    "log_touches",
    "folds_stratified",
    "performance_summary",
    "stream_flux",
]
# also given per vector; the published time per performer covers a whole live
# analysis step on unknown hardware, so the two do not compare
VECTOR_QUERY = "features_rolling"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        measure(sf_dir, cpus, names, shared)


def measure(sf_dir: str, cpus: str, names: list[str], shared: str) -> None:
    from fluxweave.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", shared)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            times[name] = round(time.perf_counter() - start, 3)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    if VECTOR_QUERY in warm:
        vectors = QUERIES[VECTOR_QUERY](spark, sf_dir).count()
        out["ms_per_rolling_vector"] = round(1000 * warm[VECTOR_QUERY] / max(vectors, 1), 5)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
