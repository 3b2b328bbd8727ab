"""Validation: predicates that find bad rows, and verdicts that stop a job.

Verdicts look at counts or at a bounded preview, never at the bad rows as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.functions.text import as_column, is_blank

PREVIEW = 20
LABELS = (0, 1)

UNIQUE_COLUMNS = ("source_index", "source_text", "ambiguity", "processed_text")


class InvalidInput(ValueError):
    """Input that no result may be computed from."""


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise InvalidInput(f"Missing columns: {missing}")


def any_blank(columns: Sequence[str]) -> Column:
    blank: Column = F.lit(False)
    for name in columns:
        blank = blank | is_blank(name)
    return blank


def is_bad_label(label: Column | str) -> Column:
    """True unless the label is an integer 0 or 1 (text labels included)."""
    return ~F.coalesce(as_column(label).try_cast("int").isin(*LABELS), F.lit(False))


def preview(df: DataFrame, bad: Column, position: str, limit: int = PREVIEW) -> DataFrame:
    """The first ``limit`` bad rows by position."""
    return df.where(bad).orderBy(F.col(position).asc_nulls_last()).limit(limit)


def offending_labels(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels outside the domain, with their row counts."""
    bad = df.where(is_bad_label(label)).select(F.col(label).cast("string").alias("label"))
    return bad.groupBy("label").agg(F.count("*").alias("n_rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def source_consistency(
    df: DataFrame,
    key: str = "source_index",
    columns: Sequence[str] = ("source_text", "ambiguity"),
) -> DataFrame:
    """Distinct values per source and column; null is a value, null keys are skipped.

    Rows are first reduced to distinct (key, values) on the map side, so a hot
    source costs as many rows as it has distinct metadata.
    """
    distinct = df.where(F.col(key).isNotNull()).select(key, *columns).distinct()
    counts = [
        (F.count_distinct(F.col(name)) + F.max(F.col(name).isNull().cast("int"))).alias(
            f"n_{name}"
        )
        for name in columns
    ]
    return distinct.groupBy(key).agg(*counts)


def inconsistent_sources(
    df: DataFrame,
    key: str = "source_index",
    columns: Sequence[str] = ("source_text", "ambiguity"),
) -> DataFrame:
    """Sources with more than one distinct metadata row.

    A source is inconsistent in some column exactly if its distinct metadata
    tuples number more than one, which needs no distinct aggregate.
    """
    distinct = df.where(F.col(key).isNotNull()).select(key, *columns).distinct()
    return distinct.groupBy(key).agg(F.count("*").alias("n_variants")).where("n_variants > 1")


def assert_consistent(df: DataFrame, key: str = "source_index") -> None:
    bad = [row[key] for row in inconsistent_sources(df, key).select(key).limit(PREVIEW).collect()]
    if bad:
        raise InvalidInput(f"Inconsistent source metadata, {key}: {sorted(bad)}")


def validate_unique(df: DataFrame) -> DataFrame:
    """Pre-flight of pair scoring; returns the table with the needed columns.

    One pass reduces the table to distinct source metadata with a blank count,
    which answers both the blank and the consistency check.
    """
    require_columns(df, UNIQUE_COLUMNS)
    table = df.select(*UNIQUE_COLUMNS)
    meta = ["source_index", "source_text", "ambiguity"]
    variants = table.groupBy(*meta).agg(
        F.count_if(any_blank(["source_text", "processed_text"])).alias("n_blank")
    )
    per_source = variants.groupBy("source_index").agg(
        F.count("*").alias("n_variants"), F.sum("n_blank").alias("n_blank")
    )
    split = F.col("source_index").isNotNull() & (F.col("n_variants") > 1)
    n_blank, n_split = per_source.agg(
        F.coalesce(F.sum("n_blank"), F.lit(0)), F.count_if(split)
    ).first()
    if n_blank:
        bad = preview(table, any_blank(["source_text", "processed_text"]), "source_index")
        rows = ", ".join(str(row[0]) for row in bad.select("source_index").collect())
        raise InvalidInput(f"{n_blank} rows with empty source or text, source_index: {rows}")
    keys = ["source_index", "processed_text"]
    if duplicate_keys(table, keys).limit(1).count():
        raise InvalidInput(f"Duplicate {keys} rows; use the unique translation table")
    if n_split:
        assert_consistent(table)
    return table


def assert_same_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """Both sides hold the same keys, each as often as the other."""
    left_n = left.groupBy(*on).agg(F.count("*").alias("n")).withColumn("side", F.lit(1))
    right_n = right.groupBy(*on).agg(F.count("*").alias("n")).withColumn("side", F.lit(-1))
    both = left_n.unionByName(right_n)
    uneven = both.groupBy(*on).agg(F.sum(F.col("n") * F.col("side")).alias("d")).where("d <> 0")
    n = uneven.count()
    if n:
        raise InvalidInput(f"{n} keys of {list(on)} differ between inputs and outputs")
