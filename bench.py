"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: The six shapes of the engine benchmark, then growth, forecasts, retrieval and evaluation.
NAMES = (
    "agg_count_by_year", "srt_topk_tiebreak", "agg_conditional_rate", "win_rank_desc", "agg_count_distinct", "flt_partition_eq",
    "win_growth_latest", "ts_backtest", "win_lags_features", "chk_window_offsets", "sec_mask_pii_documents", "ret_dense_topk", "ret_bm25_global", "ev_psi",
)


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomwright.plans.registry import QUERIES

    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # the first warms up
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs[1:])[1], 4)
    spark.stop()
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
