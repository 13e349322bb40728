"""Session defaults and lineage cutting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "planspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (AQE, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` is used as it is. Without
    one, a folder in the warehouse is taken: executors and driver share the
    warehouse wherever tables can be written, and it outlives a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    sc.setCheckpointDir(named)
    return named


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Whatever is planned and run within drops its shuffle files as soon as it has ended.

    Otherwise they stay until the driver happens to collect its garbage, so
    that a query of many rounds holds the files of all of them.
    """
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and drop its lineage, and the shuffle files that it took."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled, however small Spark takes it for.

    The size of listed cells, ring edges or grid points is guessed from the
    file that they come from, before they are listed; a join of them must not
    send one side to the driver on that guess.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Unlike a checkpoint, the table carries nothing of the plan that made it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table that ``stored`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

