"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores,
BENCH_QUERIES optionally a comma-separated choice of registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prj_log_ratio",
    "crt_atomic",
    "crt_k_from_frr",
    "crt_k_from_eps",
    "crt_rejection_sampling",
    "gate_batch_report",
    "crt_eps_table",
    "crt_constriction_by_frr",
    "crv_detection",
    "crv_eps_frr",
    "crv_certified_benchmark",
    "agg_histogram",
    "agg_ecdf",
    "smp_shuffle_split",
    "seq_pack_blocks",
    "tok_words",
    "tok_bpe_pairs",
    "lm_score_corpus",
    "certified_corpus",
    "agg_rouge",
    "tsk_sort",
    "tsk_score",
    "stm_gate",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    from ratiocert.session import local_session
    from registry import QUERIES

    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{sf}/nation.parquet").count()
    times: dict[str, float] = {}
    for key in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
