"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables, ``BENCH_CPUS`` the
number of local cores. Each query is planned and run in full; its rows go nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hearthline.session import local_session, use_folder  # noqa: E402
from verification.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "merge_hourly_sources",   # raw telemetry, sensors and forecasts to hourly rows
    "hourly_energy",
    "flow_segments",
    "time_weighted_avg_locf",
    "asof_forecast",
    "cleaning_report",
    "engineer_features",
    "fit_energy_params",
    "write_rswt_params",
    "in_sample_metrics",
    "oos_metrics",            # refits and recursive 48-step forecasts of every hour
    "sweep_n",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    use_folder(tempfile.mkdtemp(prefix="hearthline-bench-"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
