"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

from armlight.plans import catalog, replay
from armlight.session import build_session

HEADLINE = (
    "score_mlp", "table_profile", "dim_users", "join_fact_to_dims", "event_sequence", "optimal_reward",
    "context_cross_join", "nearest_vector", "policy_greedy_deep", "policy_metrics", "policy_metrics_logit_egreedy",
    "policy_metrics_deep_greedy", "policy_metrics_proto_arm", "learning_curve", "policy_gradient_step",
    "posterior_precision", "lift_bins", "feature_set_eval", "shuffled_batches", "policy_rounds_linear",
    "stream_batch_metrics",
)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus), memory="12g")
    # loads classes and starts the Python workers; no query of the list is run
    run(catalog.QUERIES["scan_parquet"](spark, folder))
    times = {}
    start = time.time()
    replay.replay_tables(spark, folder)
    times["replay_tables"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        run(catalog.QUERIES[name](spark, folder))
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
