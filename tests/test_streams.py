"""Streaming jobs and file sources."""

import json
import os

from planspark.sources import files as S
from planspark.streaming import jobs as J


def write(folder, name, payload):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False))


def test_stream_drawings_waits_for_all_kinds(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    os.makedirs(src)
    arcs = {"dwg_name": "p", "arc_items": [{"rect": [0, 0, 1, 1], "point": [0, 0, 1, 1]}]}
    text = {"dwg_name": "p", "text_items": [{"text": "厨房", "x": 1, "y": 2}]}

    def run():
        job = J.stream_drawings(spark, src, out, ck, lambda items: items.select("file", "kind", "item_no"), kinds=2)
        query = job.trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((os.path.basename(r.file), r.kind) for r in spark.read.schema("file string, kind string, item_no int").parquet(out).collect())

    def put(name, payload, seconds):
        write(src, name, payload)
        os.utime(os.path.join(src, name), (1_700_000_000 + seconds,) * 2)

    put("p_ArcDoor.json", arcs, 99)
    put("q_ArcDoor.json", arcs, 0)
    assert run() == []
    # the second file comes in another window of the waiting time
    put("p_Text.json", text, 101)
    assert run() == [("p_ArcDoor.json", "ArcDoor"), ("p_Text.json", "Text")]
    # a drawing left incomplete for too long is given up; a repeated run gives nothing new
    put("r_ArcDoor.json", arcs, 1000)
    run()
    put("q_Text.json", text, 1001)
    assert len(run()) == 2 and len(run()) == 2


def test_stream_task_status(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "task_id string, status string, ts timestamp"
    rows = [[("a", "processing", 0), ("b", "processing", 0)], [("a", "sucess", 5)], [("a", "fail", 3)]]
    for batch in rows:
        spark.createDataFrame(batch, "task_id string, status string, m int").selectExpr(
            "task_id", "status", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) AS ts"
        ).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        J.stream_task_status(stream, out, ck).trigger(availableNow=True).start().awaitTermination(120)
    changes = spark.read.parquet(out)
    assert {(r.task_id, r.status) for r in J.current_status(changes).collect()} == {("a", "sucess"), ("b", "processing")}
    assert {r.batch for r in changes.where("task_id = 'a'").collect()} <= {0, 1, 2}


def test_status_table_stays_small(spark, tmp_path):
    """Twenty batches over three buckets, each run twice: two versions of a bucket at most, and the last status of each task."""
    target, want = str(tmp_path / "out"), {}
    for batch_id in range(20):
        rows = [(f"t{(batch_id * 3 + k) % 11}", f"s{batch_id}.{k}", batch_id * 10 + k) for k in range(2)]
        want |= {t: s for t, s, _ in rows}
        batch = spark.createDataFrame(rows, "task_id string, status string, m int").selectExpr(
            "task_id", "status", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) AS ts"
        )
        J.upsert_status(batch, batch_id, target, buckets=3)
        if batch_id % 5 == 0:
            J.upsert_status(batch, batch_id, target, buckets=3)
        assert max(len(own) for own in J.versions(spark, target).values()) <= 2
    found = J.current_status(spark.read.parquet(target)).collect()
    assert {r.task_id: r.status for r in found} == want and len(found) == len(want)


def test_nested_svg_groups(spark):
    svg = '<svg><g id="A-WALL"><g id="WALL-in"><path d="M 0,0 L 1,0"/></g><g/><path d="M 1,0 L 2,0"/></g><path d="M 5,5 L 6,6"/><g id="x"><g id="WALL"><path d="M 2,0 L 3,0"/></g></g></svg>'
    got = S.parse_svg(spark.createDataFrame([("f", svg)], "file string, content string")).collect()
    assert sorted((r.group_no, r.path_no, r.x1, r.x2) for r in got) == [(0, 0, 0.0, 1.0), (0, 1, 1.0, 2.0), (1, 0, 2.0, 3.0)]


def test_bad_rows_drop_the_whole_dump(spark, tmp_path):
    write(tmp_path, "a.txt", "range: 0, 0, 9, 9\ntotal: 1\nDoor1: 1, 2, 3, 4, 0, 0.5\n")
    write(tmp_path, "b.txt", "range: 0, 0, 9, 9\ntotal: 2\nDoor1: 1, 2, 3, 4, 0, 0.5\nDoor2: 1, 2, oops\n")
    rows = S.parse_dump(S.read_texts(spark, str(tmp_path))).collect()
    assert [(r.item_no, r.v) for r in rows] == [(1, [1.0, 2.0, 3.0, 4.0, 0.0, 0.5])]
