"""Times the headline queries, warm: the median of three runs after one; prints one JSON line."""

import json
import os
import statistics
import time

from cindergrid.plans.catalog import Q
from cindergrid.session import session

HEADLINE = ["zonal_terrain", "zonal_mode_fuel", "antecedent_full", "pct_rank_avg", "dedupe_latest", "average_precision", "roc_auc", "exact_quantiles", "spread_prob", "nearest_axis", "neighbour_slope", "polygon_area_clip", "geojson_features", "training_table"]

if __name__ == "__main__":
    d, spark, took = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), session(os.environ.get("BENCH_CPUS", "8")), {}
    spark.sparkContext.setLogLevel("ERROR")
    for q in HEADLINE:
        runs = []
        for _ in range(4):
            t = time.time()
            Q[q](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[q] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rpartition("sf")[2]}))
