"""Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ambilens.operators.checks import require_columns
from ambilens.sinks.tables import current, entries


def read_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns only; the scan reads nothing else."""
    try:
        table = spark.read.parquet(current(spark, path))
    except AnalysisException as error:
        raise FileNotFoundError(f"No Parquet table at {path}") from error
    require_columns(table, columns)
    return table.select(*columns)


def read_model_tables(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """Union of the ``*.parquet`` entries directly under ``folder``.

    Entries may be files or Spark-written folders; of one that is being replaced, the
    rows are those of its current version.
    """
    folder = folder.rstrip("/")
    named = f"{folder}/*.parquet"
    pending = [f"{folder}/{name[1:-len('-next.json')]}" for name in entries(spark, f"{folder}/_*.parquet-next.json")]
    moved = {path: current(spark, path) for path in pending}
    paths = [named]
    if moved:
        paths = [p for p in (f"{folder}/{name}" for name in entries(spark, named)) if p not in moved] + [*moved.values()]
    try:
        table = spark.read.parquet(*paths)
    except AnalysisException as error:
        raise FileNotFoundError(f"No Parquet files in {folder}") from error
    require_columns(table, columns)
    return table.select(*columns)
