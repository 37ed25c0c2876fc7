"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default the sf0.1 tables) on local[BENCH_CPUS]. Every query runs
twice and the second run counts; results are fully computed into a no-op sink.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from leadline.catalog import QUERIES  # noqa: E402
from leadline.session import build_session  # noqa: E402

HEADLINE = [
    "promise_recommendation", "promise_calibration", "critical_cities", "delay_crosstab", "sales_by_product",
    "sales_by_customer_value_band", "sales_versus_views", "profile_describe_numeric", "profile_cardinality",
    "arrival_history_on_lines", "arrival_rule_scores", "sales_history_on_lines", "demand_panel", "demand_rule_scores",
    "demand_total_gap", "walk_forward_scores", "frozen_versus_walk_forward", "split_by_share", "sales_model_coefficients",
    "walk_forward_model_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": pathlib.Path(folder).name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
