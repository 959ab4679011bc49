"""Time the headline queries and print one JSON line.

``$BENCH_SF_DIR`` names the tables (default sf0.1), ``$BENCH_CPUS`` the local cores, ``$BENCH_REPEATS`` the runs per query,
of which the median counts. Every run rebuilds all the stages it needs, from the raw records on. One query warms up the session
before anything is timed. The learners' full search is not among the headline queries: it takes too long.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fluxlake.catalog import bindings  # noqa: E402
from fluxlake.catalog.queries import QUERIES  # noqa: E402
from fluxlake.session import build_session  # noqa: E402

HEADLINE = [
    "resample_mean", "align_grid", "dedup_keep_first", "drop_corrupt_ts", "despike_mad", "interpolate_gaps", "robust_scale",
    "dynamic_lag", "rolling_stats", "ema", "feature_table", "chrono_split", "sequence_windows", "asof_nearest", "best_alpha",
    "validate_truth", "parse_text_auto", "scan_archive", "rolling_stats_by_key", "resample_by_key",
    "interpolate_gaps_by_key", "asof_by_key", "sequence_chunks", "ingest_folders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    def timed(name: str) -> float:
        bindings.forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timed("feature_table")
    seconds = {name: round(statistics.median(timed(name) for _ in range(repeats)), 3) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
