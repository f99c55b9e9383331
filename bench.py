"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ["coauthor_subset", "mad_outlier", "eav_pivot_lag", "z_score", "cascade_match", "wide_star", "citation_chain", "accent_join", "identity_branches", "vault_hub_link", "surrogate_ids_large", "section_validation", "run_metrics", "sections_from_lines", "grid_parse", "html_links", "line_parity_ratio", "histogram"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
    from scholion.plans.queries import QUERIES
    from scholion.session import session

    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__log__level="ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the second run has its code compiled
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
