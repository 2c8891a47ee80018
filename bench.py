"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS``
(default 8) choose data and cores.  Each query runs over its whole tables
into Spark's ``noop`` sink; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tablerecon.session import recommended_conf
from tablerecon.workload import QUERIES

HEADLINE = [
    "orders_summary",
    "orders_text_summary",
    "orders_diff_records",
    "orders_annotate_target",
    "orders_report_sections",
    "lines_summary",
    "sql_mode_fanout",
    "sql_mode_pair_summary",
    "compare_text_records",
    "gate_counts",
    "duplicate_keys",
    "dedup_keep_first",
    "missing_rows",
    "flag_exists_combined_key",
    "map_values_preferring",
    "apply_updates",
    "net_vouchers",
    "calc_rules",
    "parse_dates",
    "split_by_rows",
    "merge_tables",
]


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablerecon-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    conf = recommended_conf(0) | {
        "spark.sql.shuffle.partitions": cpus,
        # The tables are single small files: cut them so that every core scans.
        "spark.sql.files.maxPartitionBytes": str(4 << 20),
        "spark.sql.files.openCostInBytes": str(1 << 20),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best of two runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
