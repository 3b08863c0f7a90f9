"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads. Every query writes
its whole result to the ``noop`` sink, so nothing is collected and no column is
pruned away. The value is the sum of the medians of BENCH_RUNS runs per query;
``planning`` is the part of it that building and planning takes. The session is
the package's own.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

from haulframe.catalog.queries import QUERIES
from haulframe.session import build_session

HEADLINES = (
    "top_n_join_labels", "kpi_summary", "species_list", "species_list_corrected", "monthly_evolution",
    "fruitless_outings", "fruitless_share", "cpue_by_mode", "cpue_by_species", "cpue_summary",
    "biomass_split", "zone_left_join", "exact_quantile", "tukey_axis_bound", "boxplot_summary",
    "size_histogram", "dedupe_keep_first", "outing_id", "clean_pipeline", "line_total",
    "length_weight_points", "curve",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    timings, planning = {}, {}
    for name in names:
        totals, plans = [], []
        for _ in range(runs):
            start = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df._jdf.queryExecution().executedPlan()
            plans.append(time.perf_counter() - start)
            df.write.format("noop").mode("overwrite").save()
            totals.append(time.perf_counter() - start)
        timings[name], planning[name] = round(median(totals), 3), round(median(plans), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline query seconds, total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "planning": planning, "runs": runs, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
