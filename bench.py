"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each time covers building the plan and computing every output row (``noop`` sink).
Stored feature and candidate tables that a query needs are built inside the first
query that uses them, so that cost is part of the reported numbers; ``stored_tables`` tells it apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayfunnel import build_session  # noqa: E402
from wayfunnel.adapters import BUILD_SECONDS  # noqa: E402
from wayfunnel.plans import load_all  # noqa: E402
from wayfunnel.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "fun1_slot_metrics", "fun4_request_metrics", "fun11_daily_breakdowns", "fun16_daily_report", "fun17_reconciliation",
    "evt8_recommend_clicks", "evt9_recommend_conversions", "agg2_interactions", "agg10_user_features",
    "agg16_item_features", "cln7_clean_interactions", "dq10_interactions_quality", "sql3_interactions_with_items_and_users",
    "rec1_behaviour_neighbours", "rec2_user_neighbours", "rec5_tag_neighbours", "rec9_content_neighbours",
    "rec11_vector_neighbours", "exp1_assigned_variant", "ml1_item_ranking_data",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{folder}/events.parquet").count()  # start executors before the first timing
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "stored_tables": BUILD_SECONDS, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
