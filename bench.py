"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evalgrid.plans import load_all  # noqa: E402
from evalgrid.session import local_session  # noqa: E402

HEADLINE = [
    "q_d1_zone_accuracy", "q_d2_macro_pooled", "q_d4_confusion", "q_d10_icc", "q_d16_kshot", "q_b5_mm_error", "q_a14_qa_profile",
    "q_c3_nearest", "q_c3_nearest_within", "q_c4_window_join", "q_d13_lag_scan", "q_g4_windows", "q_g6_answers", "q_g7_repair", "q_g8_smooth", "q_g9_slow",
    "q_g2_reachability", "q_d27_cells", "q_e1_cluster_ci", "q_e5_by_cluster", "q_m1_claims", "q_m2_rollup", "q_l2_repeat", "q_l7_trials",
    "q_d18_rank_at_k", "q_d19_summary", "q_d22_grouping_sets", "q_e2_row_ci", "q_e4_paired", "q_j1_loo_popular", "q_j3_cosine_topk", "q_j9_rank_curve",
    "q_b8_norm", "q_b10_match", "q_b11_phrases", "q_b12_list", "q_j2_overlap", "q_j4_jaccard", "q_h3_stratified",
    "q_d23_kappa", "q_d25_vs_labels", "q_k1_sheet", "q_d15_fit_both_ways", "q_f1_logo_linear", "q_f5_ablation", "q_d33_corr_tertiles",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    registry = load_all()
    names = list(registry) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.read.parquet(f"{sf}/nation.parquet").count()  # JVM and reader start-up
    times = {}
    for name in names:
        t0 = time.time()
        registry[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
