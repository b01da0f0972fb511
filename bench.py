"""Headline queries at one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slatewright.plans import registry  # noqa: E402
from slatewright.plans.prepared import dataset  # noqa: E402
from slatewright.plans.registry.neighbours import fitted  # noqa: E402
from slatewright.session import local_session  # noqa: E402

HEADLINES = (
    "ordered_log_s1_d15", "k_core_d4", "split_fraction_d7", "folds_chain_d11_d13",
    "drop_untrained_d16", "evolving_recent_prompts_d19", "popularity_curve_a6",
    "session_length_summary_a4", "popular_report_n2", "model_report_n1_n6", "sampled_popular_n16",
    "slate_overlap_a17", "neighbour_sample_random_k4", "neighbour_sample_idf_k6",
    "recommend_sknn_k20_k25_k26", "recommend_vsknn_k20_k25_k26", "recommend_sfsknn_k20_k25_k26",
    "recommend_similar_cosine_e6_e9_e10", "recommend_similar_euclidean_e8", "pair_distances_a9",
    "pca_16_v1", "rank_ensemble_h1", "popularity_filter_h4", "diversity_filter_h5",
    "list_examples_l6", "parse_list_l11", "fill_unmatched_l15", "next_items_q2", "cloze_q4_q5_q6",
    "similarity_cutoffs_a15", "match_report_l17", "online_prompts_st1",
    "own_metrics_n9_u1",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    queries = registry.collect()[0]
    seconds: dict[str, float] = {}
    started = time.time()
    dataset(spark, sf_dir)
    dataset(spark, sf_dir, on_vectors=True)
    seconds["prepare_dataset"] = round(time.time() - started, 3)
    started = time.time()
    fitted(spark, sf_dir)  # the neighbour index that all recommend_* entries but the vector ones read
    seconds["fit_neighbour_index"] = round(time.time() - started, 3)
    for name in HEADLINES:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
