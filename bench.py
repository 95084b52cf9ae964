"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8); every run executes the full plan into Spark's no-op
sink. One untimed warm-up query runs first. Reports the median of ``$BENCH_REPS`` runs
(default 3) per query and prints ONE JSON line. ``$BENCH_EVENT_LOG_DIR`` turns on
Spark's event log there (stage and task times without the UI).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["eval_summary", "stratified_sample", "batch_plan", "trim_repetition", "first_repeated_ngram",
            "rouge1", "rougeL_counts", "encode_tokens", "build_vocab", "decode_tokens", "label_mask",
            "clean_repetition", "training_table", "gen_metrics_scored"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    from babelqa.plans.queries import QUERIES
    from babelqa.session import get_session
    extra = {"spark.driver.memory": "16g"}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    if log_dir:  # stage/task times without the UI: Spark's event log in a scratch folder
        os.makedirs(log_dir, exist_ok=True)
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = get_session(f"local[{cpus}]", app="babelqa-bench", shuffle_partitions=2 * cpus, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed warm-up (JIT, first file listing) so the first headline query is not
    # charged for JVM start-up effects.
    QUERIES["lang_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "reps": reps, "spark": spark.version}))


if __name__ == "__main__":
    main()
