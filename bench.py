"""Times headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mnemo import plans  # noqa: E402
from mnemo.session import get_session  # noqa: E402

HEADLINE = [
    "bm25_search", "like_search", "vector_topk", "hybrid_rrf", "hybrid_rerank", "context_scores", "context_pack", "latest_live", "ns_stats",
    "expand_2hop", "pagerank_personalized", "components", "reflect_actions", "gc_stale", "exact_dups", "paraphrase_pairs", "tfidf_topics", "sequence_maximal", "eval_recall_ndcg_mrr",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = get_session(f"local[{cpus}]", max(8, cpus), spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["ns_stats"](spark, path).count()  # start the engine
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        plans.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    found = re.search(r"sf([\d.]+)", path)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(found[1]) if found else path}))


if __name__ == "__main__":
    main()
