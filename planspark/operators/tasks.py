"""The task log: filters, search, paging, patches and the job queue's events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.functions.text import js_date, type_fanout
from planspark.operators.ordering import ranked


def with_time(tasks: DataFrame, source: str = "create_time", name: str = "created") -> DataFrame:
    return tasks.withColumn(name, js_date(F.col(source)))


def by_user_sorted(tasks: DataFrame, user: Column | None = None) -> DataFrame:
    """Tasks with their parsed time, newest first; of one user or of all."""
    found = tasks if user is None else tasks.where(F.col("user_id") == user)
    return with_time(found).orderBy(F.col("created").desc(), F.col("task_id"))


def pages(tasks: DataFrame, page: int, limit: int, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """One page per user, newest first, with the user's total.

    The page is the row range [(page - 1) * limit, page * limit); a page past
    the end is empty.
    """
    keys = list(keys)
    timed = with_time(tasks)
    totals = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    order = [F.col("created").desc(), F.col("task_id")]
    numbered = ranked(timed, keys, order, "pos", bounded=False)
    rows = numbered.where((F.col("pos") > (page - 1) * limit) & (F.col("pos") <= page * limit))
    return rows.join(totals, keys)


def page_of(tasks: DataFrame, page: int, limit: int) -> DataFrame:
    """One page of an already filtered task list (a top-k read, no full sort)."""
    timed = with_time(tasks)
    ordered = timed.orderBy(F.col("created").desc(), F.col("task_id"))
    return ordered.offset((page - 1) * limit).limit(limit)


def search(
    tasks: DataFrame, title: str = "", type: str = "All", sort: str = "-time", user: Column | None = None
) -> DataFrame:
    """Title substring (ignoring case) and type; sorted by '+time' or '-time', else unsorted."""
    found = tasks.where(F.contains(F.lower("task_name"), F.lit(title.lower())))
    if type != "All":
        found = found.where(F.col("task_type") == type)
    if user is not None:
        found = found.where(F.col("user_id") == user)
    found = with_time(found)
    if sort == "-time":
        return found.orderBy(F.col("created").desc(), F.col("task_id"))
    if sort == "+time":
        return found.orderBy(F.col("created"), F.col("task_id"))
    return found


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per name, as a lookup by name returns it."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def recent(tasks: DataFrame, n: int = 10) -> DataFrame:
    return with_time(tasks).orderBy(F.col("created").desc(), F.col("task_id")).limit(n)


def patch(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Overwrite the non-null fields of ``patches``, matched by ``key`` (unique in ``patches``)."""
    fields = [c for c in patches.columns if c != key]
    new = patches.select(key, *[F.col(c).alias(f"__new_{c}") for c in fields])
    joined = df.join(new, key, "left")
    return joined.select(
        *[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns]
    )


def set_where(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({n: F.when(where, v).otherwise(F.col(n)) for n, v in values.items()})


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def jobs(tasks: DataFrame) -> DataFrame:
    """One row per recognition job of a task."""
    return tasks.withColumn("job", F.explode(type_fanout(F.col("task_type"))))


def latest_status(events: DataFrame, key: str = "task_id", time: str = "ts") -> DataFrame:
    """The last status per task; the larger status text wins on equal times."""
    return events.groupBy(key).agg(
        F.max_by("status", F.struct(time, "status")).alias("status"), F.max(time).alias(time)
    )


def skip_done(inputs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs whose result does not exist yet."""
    return inputs.join(results.select(*keys).distinct(), list(keys), "left_anti")


def result_lookup(results: DataFrame, task_id: Column, kind: str) -> DataFrame:
    """Result rows of one task and kind (Door, Window, Wall, Area or Bill)."""
    return results.where((F.col("task_id") == task_id) & (F.col("kind") == kind))
