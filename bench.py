"""Headline queries timed on one machine; prints one JSON line.

Every query is run once to warm up code generation and the file cache and then
timed; its result is written to Spark's no-op sink, so all rows and columns are
computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from clickfeat.registry import QUERIES
from clickfeat.session import build_session

HEADLINE = [
    "flagship",
    "final_features",
    "catalogue",
    "chunk_features",
    "agg_count",
    "agg_countuniq",
    "agg_var",
    "next_click",
    "cumcount",
    "shift_rows",
    "row_index",
    "profiles",
    "profile_lookup",
    "match_ids_consume",
    "match_ids_pairwise",
    "pair_pos_neg",
    "auc_exact",
    "auc_exact_items",
    "describe_full",
    "folds_contiguous",
    "sample_exact",
    "shuffle_batches",
    "blend_final",
    "scan_clicks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        for attempt in ("warm", "timed"):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of warm single runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    sys.exit(main())
