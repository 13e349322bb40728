"""Task log queries over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, table, view
from planspark.catalog.registry import query
from planspark.functions import text as T
from planspark.operators import tasks as K

ZONE = " GMT+0800 (中国标准时间)"
_TASKS = f"""WITH {cte('tasks')}, t AS (SELECT *, strftime(ts, '%a %b %d %Y %H:%M:%S') || '{ZONE}' AS create_time,
  date_trunc('second', ts) AS created FROM tasks) """


def tasks(spark, d):
    stamp = F.concat(F.date_format("ts", "EEE MMM dd yyyy HH:mm:ss"), F.lit(ZONE))
    return view(spark, d, "tasks").withColumn("create_time", stamp)


@query("js_date", _TASKS + "SELECT task_id, created FROM t")
def js_date(spark, d):
    return tasks(spark, d).select("task_id", T.js_date(F.col("create_time")).alias("created"))


@query("src_tasks", _TASKS + "SELECT task_id, user_id, task_type, task_name, create_time FROM t")
def src_tasks(spark, d):
    from planspark.sources.tables import TASK_COLUMNS, conform

    return conform(tasks(spark, d), TASK_COLUMNS).select("task_id", "user_id", "task_type", "task_name", "create_time")


@query("task_by_user_sorted", _TASKS + "SELECT user_id, task_id, created FROM t WHERE user_id = 8 ORDER BY created DESC")
def task_by_user_sorted(spark, d):
    return K.by_user_sorted(tasks(spark, d), F.lit(8)).select("user_id", "task_id", "created")


@query(
    "task_page",
    _TASKS + """SELECT user_id, task_id, pos, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY created DESC, task_id) AS pos, count(*) OVER (PARTITION BY user_id) AS total FROM t)
    WHERE pos > 10 AND pos <= 20""",
)
def task_page(spark, d):
    return K.pages(tasks(spark, d), page=2, limit=10).select("user_id", "task_id", "pos", "total")


@query(
    "task_search",
    _TASKS + "SELECT task_id, user_id, created FROM t WHERE contains(lower(task_name), '\"k\": 1') AND task_type = 'error'",
)
def task_search(spark, d):
    return K.search(tasks(spark, d), '"K": 1', "error", "-time").select("task_id", "user_id", "created")


@query(
    "point_lookup",
    "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part WHERE p_name = 'small ring' GROUP BY 1",
)
def point_lookup(spark, d):
    parts = table(spark, d, "part").select("p_name", "p_partkey", "p_brand")
    return K.first_by(parts.where(F.col("p_name") == "small ring"), "p_name", "p_partkey")


@query("recent_tasks_sql", _TASKS + "SELECT task_id, created FROM t ORDER BY created DESC, task_id LIMIT 10")
def recent_tasks_sql(spark, d):
    return K.recent(tasks(spark, d)).select("task_id", "created")


@query(
    "task_update",
    _TASKS + """, p AS (SELECT user_id, max(task_id) AS task_id FROM t GROUP BY 1)
    SELECT t.task_id, CASE WHEN p.task_id IS NULL THEN task_type ELSE 'All' END AS task_type,
    CASE WHEN p.task_id IS NULL THEN task_name ELSE 'plan of ' || p.user_id END AS task_name
    FROM t LEFT JOIN p USING (task_id)""",
)
def task_update(spark, d):
    log = tasks(spark, d).select("task_id", "user_id", "task_type", "task_name")
    patches = log.groupBy("user_id").agg(F.max("task_id").alias("task_id")).select(
        "task_id", F.lit("All").alias("task_type"), F.concat(F.lit("plan of "), F.col("user_id")).alias("task_name")
    )
    return K.patch(log.drop("user_id"), patches, "task_id")


@query(
    "task_delete",
    _TASKS + "SELECT task_id FROM t WHERE task_id NOT IN (SELECT max(task_id) FROM t GROUP BY user_id)",
)
def task_delete(spark, d):
    log = tasks(spark, d).select("task_id", "user_id")
    gone = log.groupBy("user_id").agg(F.max("task_id").alias("task_id"))
    return K.delete(log, gone, "task_id").select("task_id")


@query(
    "stream_task_status",
    "SELECT user_id, arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY 1",
)
def stream_task_status(spark, d):
    """The status stream run over all events until none is left, then its table read."""
    from planspark.session import ensure_checkpoint_dir
    from planspark.streaming.jobs import current_status, stream_task_status as job

    folder = f"{ensure_checkpoint_dir(spark)}/status-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    rows = events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "ts")
    job(rows, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = current_status(spark.read.parquet(f"{folder}/out"))
    return found.select(F.col("task_id").alias("user_id"), "status")


@query(
    "skip_done",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def skip_done(spark, d):
    inputs = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.skip_done(inputs, done, ["o_orderkey"])


@query(
    "result_lookup",
    "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND user_id = 8",
)
def result_lookup(spark, d):
    results = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("task_id"), F.col("event_type").alias("kind"), "value"
    )
    return K.result_lookup(results, F.lit(8), "purchase").select("event_id", "value")
