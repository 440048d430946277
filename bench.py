"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2).  Every query is run once to warm up; the median of the
following runs counts.  Results are consumed in full by the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from keystead.plans import catalog
from keystead.session import local_session

HEADLINE = [
    "price_parse", "area_parse", "built_parse", "building_age", "address_normalize", "address_split", "traffic_routes",
    "clean_strings", "strict_reasons", "anomalies", "null_profile", "ratio_repair",
    "municipality_lookup", "land_blend", "land_price_contains", "trades_to_land_prices", "market_master", "market_lookup",
    "bargains", "features", "investment_scores",
    "t_score", "validity_report", "recommend", "daily_budget", "error_report", "upsert_land_prices", "iqr_clean",
    "dup_links", "dup_links_sequence", "dup_roots", "isolation_forest",
    "page_links", "page_status", "next_pages", "extract_listings", "page_images", "state_values",
    "stream_counts", "stream_budget",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "bench")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "sum of warm median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
