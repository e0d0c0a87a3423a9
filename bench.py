"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from checks.all_queries import QUERIES
from checks.compare import session

HEADLINE = (
    "shape_request", "noise_grid", "stratified_split", "noise_detection_metrics", "knn_graph",
    "knn_weighted", "export_groups", "heuristic_flags", "canonical_json", "view_pool",
    "char_ngrams", "tfidf_vocab", "tfidf", "svd_fit", "features_fit_transform",
    "confident_learning", "centroid_distances", "ensemble", "clustering_metrics",
    "overlap_report", "oof_probabilities", "source_study",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, cpus if cpus.isdigit() else "8")
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
