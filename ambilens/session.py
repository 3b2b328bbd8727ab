"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(name: str = "ambilens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` is left to the cluster unless given; ``conf`` keys use ``__`` for
    dots (``spark__driver__memory="8g"``).
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` where it is set.

    Only a local session without one (a test) gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder all executors reach")
            shared = tempfile.mkdtemp(prefix="ambilens-")
        spark.sparkContext.setCheckpointDir(shared)
        current = spark.sparkContext.getCheckpointDir()
    return shared or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(
    df: DataFrame, name: str = "stage", path: str | None = None, by: str | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table feeds several jobs: later scans are columnar, pruned and
    independent of the lineage that produced the table. ``by`` names a column with
    few values to partition by. The folder stays for the lifetime of the scratch
    space; jobs that give a ``path`` remove it themselves.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is planned and run in here go when it ends.

    Elsewhere they stay until the driver happens to collect its garbage, so that a job in
    rounds would keep those of all its rounds.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions of a query that is planned and run in here get so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
