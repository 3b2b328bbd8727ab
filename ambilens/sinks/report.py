"""Evaluation reports: a header and the result rows, as JSON.

The rows are JSON lines written in parallel; nothing gathers them in one place.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ambilens.sinks.tables import current, replacing


def write_report(
    results: DataFrame, header: dict[str, Any], path: str, overwrite: bool = False
) -> None:
    """``path/header`` holds one line, ``path/results`` one line per row."""
    spark = results.sparkSession
    line = json.dumps(header, ensure_ascii=False)
    with replacing(spark, path, overwrite) as new:
        results.write.option("ignoreNullFields", False).json(f"{new}/results")
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{new}/header")


def read_report(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> tuple[dict[str, Any], DataFrame]:
    """Header and result rows; pass their ``schema`` so that maps stay maps."""
    path = current(spark, path)
    header = json.loads(spark.read.text(f"{path}/header").first()[0])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return header, reader.json(f"{path}/results")
