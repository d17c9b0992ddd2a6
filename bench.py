"""Time the headline queries; print one JSON line.

Each query runs once to warm the JVM and once for the clock, into a sink that reads every
column of every row.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from flowwatch.operators.model import Params
from flowwatch.plans import registry, train
from flowwatch.session import local_session
from flowwatch.sources import fixtures as fx

HEADLINE = [
    "features_per_event",
    "features_batch_reference",
    "feat_time_diff",
    "feat_unique_dports",
    "signature_hits",
    "signature_dedup",
    "anomaly_alerts",
    "score_fixed_forest",
    "scan_windows",
    "port_entropy",
    "log_events",
    "logs_filtered",
    "normalize_events",
    "device_inventory",
    "device_services",
    "latest_action",
    "containment_fold",
    "lockout_states",
    "retention_counts",
    "contamination_offset",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def features_and_fit(spark, sf_dir: str) -> None:
    train.train_on_packets(fx.packets(fx.read_events(spark, sf_dir)), fx.LOCAL_IPS, Params(n_estimators=100))


def clock(run) -> float:
    run()
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "flowwatch-bench", int(cpus) if cpus.isdigit() else 8)
    times = {name: clock(lambda n=name: drain(registry.QUERIES[n](spark, sf_dir))) for name in HEADLINE}
    times["features_and_fit"] = clock(lambda: features_and_fit(spark, sf_dir))
    # The size of the published budget: 10,000 rows, 100 trees, 3.0 s.
    small = Path(sf_dir).parent / "sf0.01"
    if small.exists():
        times["features_and_fit_10k"] = clock(lambda: features_and_fit(spark, str(small)))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
