"""Time the headline steps at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query runs to completion into Spark's no-op sink.  Like the workload's own steps, the
later queries read the stored tables of the earlier ones; building those tables is timed as
``stored_*`` (``stored_embedded`` fits the curve embeddings).  A query's time is the better of two runs in a warm session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wellkin import session  # noqa: E402
from wellkin.plans import steps  # noqa: E402
from wellkin.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "peak_aligned",
    "early_rates_scalar",
    "candidate_pairs",
    "spacing_at_start",
    "ranking_features_17",
    "graded_labels",
    "knn_lookup",
    "baseline_median_forecast",
    "weighted_mae",
    "error_stats",
    "newwell_lookup",
    "batch_forecast",
    "validate_suite",
]
STORED = ["model_prod", "model_wells", "early_rates", "spacing", "candidates", "peaks", "embedded"]
#: Timed beside the total where BENCH_TRAINING is set, as they take minutes: the training matrix,
#: and the ranker of every basin with the full settings.
TRAINING = ["ranker_pairs", "rank_models"] if os.environ.get("BENCH_TRAINING") else []


def seconds(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.local(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    times = {}
    for name in STORED:
        times[f"stored_{name}"] = seconds(lambda: getattr(steps, name)(spark, sf_dir))

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        times[name] = min(seconds(lambda: run(name)) for _ in range(2))
    training = {name: seconds(lambda: getattr(steps, name)(spark, sf_dir)) for name in TRAINING}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_steps_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "training": training,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
