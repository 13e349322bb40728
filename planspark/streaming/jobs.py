"""Streaming jobs: new drawings and task status."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planspark.operators.tasks import latest_status, skip_done
from planspark.sources.files import ITEM_KINDS, parse_items

# Fixed value: how long the files of a drawing may take to arrive.
WAIT_SECONDS = 100
KIND_OF_FILE = r"([^/]*)_([A-Za-z]+)\.json$"


def complete_drawings(files: DataFrame, kinds: int, wait: int = WAIT_SECONDS) -> DataFrame:
    """The files of each drawing, once ``kinds`` different kinds have arrived.

    ``files`` streams (dwg_name, kind, ts, file, content). A drawing's files
    are kept as state under its name, at most one per kind, a later one in
    place of an earlier one. They are given out together when the last kind
    comes; a drawing that stays incomplete for ``wait`` seconds after its
    latest file is given up, and its state removed.
    """

    def gather(key, frames, state):
        held: dict[str, tuple[str, str]] = {}
        latest = 0
        if state.exists:
            names, texts, sorts, latest = state.get
            held = {k: (f, c) for k, f, c in zip(sorts, names, texts)}
        if state.hasTimedOut:
            state.remove()
            return
        for frame in frames:
            for kind, ts, file, content in zip(frame["kind"], frame["ts"], frame["file"], frame["content"]):
                held[kind] = (file, content)
                latest = max(latest, int(ts.timestamp() * 1000))
        if len(held) >= kinds:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], k, f, c) for k, (f, c) in sorted(held.items())], columns=["dwg_name", "kind", "file", "content"])
            return
        state.update(([f for f, _ in held.values()], [c for _, c in held.values()], list(held), latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait * 1000)

    return (
        files.withWatermark("ts", f"{wait} seconds")
        .groupBy("dwg_name")
        .applyInPandasWithState(
            gather,
            "dwg_name string, kind string, file string, content string",
            "files array<string>, contents array<string>, kinds array<string>, latest long",
            "append",
            "EventTimeTimeout",
        )
    )


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """(dwg_name, kind, ts, file, content) of item files named '<drawing>_<kind>.json', by their time of change."""
    texts = spark.readStream.text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return texts.select(
        F.regexp_extract(path, KIND_OF_FILE, 1).alias("dwg_name"), F.regexp_extract(path, KIND_OF_FILE, 2).alias("kind"),
        F.col("_metadata.file_modification_time").alias("ts"), path.alias("file"), F.col("value").alias("content"),
    ).where("kind <> ''")


def stream_drawings(
    spark: SparkSession, folder: str, results: str, checkpoint: str, pipeline: Callable[[DataFrame], DataFrame],
    done: DataFrame | None = None, kinds: int = len(ITEM_KINDS), wait: int = WAIT_SECONDS,
):
    """Run ``pipeline`` on the items of every drawing whose files have all arrived.

    Each batch is written under its batch id, so a batch that is run again
    after a failure replaces its own output. Files in ``done`` are skipped.
    """
    ready = complete_drawings(arriving_files(spark, folder), kinds, wait)

    def handle(batch: DataFrame, batch_id: int) -> None:
        todo = batch if done is None else skip_done(batch, done, ["file"])
        pipeline(parse_items(todo.select("file", "content"))).write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    return ready.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)


#: Buckets of the status table.
BUCKETS = 16
VERSION = re.compile(r"bucket=(\d+)/batch=(\d+)$")


def versions(spark: SparkSession, target: str) -> dict[int, dict[int, str]]:
    """The folders of a bucketed table: bucket -> batch -> path. At most two per bucket are kept."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/batch=*")
    found: dict[int, dict[int, str]] = {}
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        path = status.getPath().toString()
        if m := VERSION.search(path):
            found.setdefault(int(m[1]), {})[int(m[2])] = path
    return found


def upsert_status(batch: DataFrame, batch_id: int, target: str, buckets: int = BUCKETS) -> None:
    """Bring the last status of the tasks in ``batch`` into the table, by buckets of the task id.

    A bucket that the batch touches is written anew under its batch id, from
    its version before this batch; other buckets are left alone. A repeated
    batch replaces what it wrote. Of every touched bucket the version before
    stays until the next one, so the table never has more than two.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")
    fresh = batch.select("task_id", "status", "ts")
    touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]
    before = {b: {n: p for n, p in own.items() if n < batch_id} for b, own in versions(spark, target).items() if b in touched}
    paths = [own[max(own)] for own in before.values() if own]
    if paths:
        fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(*paths))
    rows = latest_status(fresh).withColumns({"bucket": bucket, "batch": F.lit(batch_id)})
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)
    for own in before.values():
        for n in sorted(own)[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(own[n])
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def stream_task_status(events: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep the last status per task of a stream (task_id, status, ts).

    The status is keyed state of the stream; each batch brings the tasks that
    it changes into a bucketed table. ``current_status`` reads it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_status(batch, batch_id, target, buckets)

    return (
        latest_status(events.select("task_id", "status", "ts"))
        .writeStream.foreachBatch(handle)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )


def current_status(changes: DataFrame) -> DataFrame:
    """The last status per task in the table that ``stream_task_status`` keeps; a version before adds nothing newer."""
    return latest_status(changes.select("task_id", "status", "ts"))
