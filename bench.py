"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query is
planned and run in full, its rows thrown away by the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from eligo.registry import REGISTRY
from eligo.registry.common import Tables
from eligo.session import build_session

HEADLINE = [
    "g14_recommend_top10", "g15_ineligible", "g20_match_table", "g21_stored_rules", "f10_listing",
    "f16_nested_children", "f17_candidates", "h05_overview", "a06_content_hash", "a15_portal_api",
    "a18_card_listing", "a20_ministry_page", "b26_normalize", "c09_canonical_batch", "d03_in_batch_dedup",
    "d07_near_names", "d09_merge", "d15_stats", "e03_embed_documents", "e07_cosine_top_k",
    "e08_approximate_top_k", "e10_hybrid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, sf_dir)
    tables.f_schemes.write.format("noop").mode("overwrite").save()  # start the JVM side once
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY.queries[name](tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
