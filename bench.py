"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from planspark.catalog import load
from planspark.session import session

HEADLINE = (
    "viewport_rect", "door_line_pairs", "rect_drop_contained", "door_arc_match", "double_door_merge",
    "iou_pairs", "nms", "seg_merge_collinear", "seg_split", "room_label_join", "dict_regex_first",
    "vocab_topk", "task_page", "classification_report", "split_train_val_test", "legend_bill", "doors_classify",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", master=f"local[{cpus}]", **{
        "spark__sql__shuffle__partitions": cpus,
        "spark__driver__memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__checkpoint__dir": tempfile.mkdtemp(prefix="planspark-bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # session start, code loading and the first compilation are no query's time
    queries[HEADLINE[0]](spark, sf_dir).limit(1).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
