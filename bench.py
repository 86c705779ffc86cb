"""Time headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "prepared_summary", "profile_missing", "profile_distinct", "profile_roles", "detect_target", "quality_score", "clean_policy",
    "dedup_rows", "impute_auto", "table_diff", "scale_standard", "scale_robust", "encode_auto", "encode_label_shuffled",
    "encode_target_mean", "bin_quantile", "bin_kmeans", "row_stats", "polynomial", "text_counts", "text_vocab", "text_sequence", "text_tfidf",
    "text_sentiment", "datetime_parts_full", "f_classif", "select_k_best", "reduce_pca", "cluster_features", "value_counts", "histogram",
    "box_stats", "corr_matrix", "chi_square", "vif", "split_random", "split_stratified", "split_timeseries", "kfold", "kfold_group", "split_stratified_many",
    "oversample", "undersample", "smote", "vectorize", "run_autonomy", "run_summary", "stage_status", "stream_run_metrics", "scan_csv", "prepare",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from prepspark.catalog import QUERIES
    from prepspark.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
