"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from unitloom.plans.all import QUERIES
from unitloom.session import local_session

HEADLINE = [
    "C1_segment_word",
    "C5_segment_core",
    "C8_combine_boundaries",
    "E1_unit_freq_top50",
    "E2_coverage_curve",
    "E10_char_profile",
    "B3_drop_seen",
    "B5_budget_by_doc",
    "D1_make_windows",
    "D9_future_targets",
    "D13_packing_waste",
    "C16_score_distinct",
    "C17_resplit_cascade",
    "C18_apply_mapping",
    "C15_encode_with_vocab",
    "F4_unit_targets",
    "G1_knn_cosine",
    "H3_mc_accuracy",
    "H5_length_bias",
    "I1_rolling_mean",
    "I4_spike_flags",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="unitloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("C1_segment_word", "E1_unit_freq_top50"):  # warm the JVM and the Python workers
        timed(spark, name, sf_dir)
    seconds = {}
    for name in names:
        seconds[name] = round(timed(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {}
    if "C1_segment_word" in seconds:
        units = QUERIES["A7_shard_meta"](spark, sf_dir).selectExpr("sum(n_units)").first()[0]
        rates["segment_units_per_sec"] = round(units / seconds["C1_segment_word"])
        if "C18_apply_mapping" in seconds:
            rates["score_resplit_units_per_sec"] = round(units / seconds["C18_apply_mapping"])
    if "F4_unit_targets" in seconds:
        convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
        rates["conversations_per_sec"] = round(convs / seconds["F4_unit_targets"])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
