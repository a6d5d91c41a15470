"""Wall time per query; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import QUERIES, SQL  # noqa: E402
from tidemark.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
# the headline queries: one or more of every operator group
HEADLINE = [
    "cohort", "admit_label", "window_minmax", "labs_in_window", "first_in_window", "window_pivot",
    "multi_window_features", "shipments_near_order", "first_value_pivot", "event_within_24h", "composite_outcome",
    "prevalence", "final_table", "safe_cast", "expand_abbrev", "deid_clean", "substring_rules", "regex_override",
    "modal_text", "relabel", "label_shift", "known_fixes", "ngram_counts", "ctfidf_top_words", "jaccard_pairs",
    "merge_topics", "heterogeneity", "topic_report", "subgroup_metrics", "risk_coverage", "percentiles",
    "split_fraction", "median_impute", "standardize", "composite_score", "sweep_rank", "grid_clusters", "sweep",
]


def main():
    names = sys.argv[1:] or [n for n in HEADLINE if n in SQL]
    spark = local_session(CORES, partitions=max(8, int(CORES) if CORES.isdigit() else 8), memory="16g")
    QUERIES["row_count"](spark, FOLDER).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": CORES,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
