"""Time the headline queries; prints one JSON line.

Every query runs to completion into a sink that discards rows. One warm-up, then
the median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from geomarket.queries import QUERIES
from geomarket.session import local_session

HEADLINE = [
    "load_sales", "price_per_sqft", "filter_sales", "bbox_sales", "distinct_sorted", "price_summary",
    "headline_metrics", "monthly_medians", "monthly_sales", "recent_sales", "month_adjustment", "rebase_sales",
    "approx_price_quantiles", "dedupe_listings", "flag_duplicates", "listings_table", "cell_index", "cell_rollup",
    "cell_medians", "zoom_clusters", "points_in_polygons", "points_within_buffer", "listings_near_places",
    "nearest_place", "geojson_features", "geojson_collections", "variogram", "kriging_neighbours", "kriging_surface", "stream_listings",
    "stream_monthly_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("geomarket-bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(4):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
