"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from tallgrass.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "core_q01", "core_q02", "core_q03", "core_q04", "core_q05", "core_q06", "core_q07", "core_q08", "core_q09", "core_q10", "exact_avg_grouped", "filter_sum_grouped", "agg_multi",
    "join_inner_star", "join_inner_fact", "tpch_q3_revenue", "tpch_q5", "tpch_q10", "tpch_q12", "tpch_q18", "suffstats_pushed", "est_sum_clt", "est_cluster_sum", "join_cluster_summary", "approx_adaptive",
)


def main() -> None:
    spark = session(f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    from tallgrass.queries import QUERIES

    QUERIES["core_q09"](spark, SF_DIR).collect()  # starts the engine
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).collect()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
