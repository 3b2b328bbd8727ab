"""Ordinals: 0-based positions of rows in an order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ambilens.operators.skew import lookup_join
from ambilens.session import scratch_root

# monotonically_increasing_id() puts the partition number above these bits.
_ROW_BITS = 33


def _position(keys: DataFrame, name: str) -> DataFrame:
    """Global position of rows in partition order, then row order."""
    fixed = keys.checkpoint()
    marked = fixed.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", _ROW_BITS)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row per partition: the window and the broadcast are bounded by the
    # number of shuffle partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    row = F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        marked.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + row)
        .drop("__id", "__part", "__offset")
    )


def with_ordinal(df: DataFrame, key: Sequence[str], name: str = "index") -> DataFrame:
    """Number rows by ascending ``key``, which must be unique and not null.

    Only the key columns are sorted and checkpointed (partition numbers must not
    change between counting and numbering); the other columns join back by key.
    """
    scratch_root(df.sparkSession)
    key = list(key)
    numbered = _position(df.select(*key).orderBy(*key), name)
    if set(df.columns) == set(key):
        return numbered
    return df.join(numbered, key)


def group_ordinal(
    df: DataFrame, group: str, key: Sequence[str], name: str
) -> DataFrame:
    """Number rows by ``key`` within ``group``; hot groups spread over tasks.

    (group, key) must be unique and not null. Rows are sorted once, with all their
    columns, and checkpointed; the rank is the global position minus the first position
    of the group, so no group has to fit in one task and nothing is joined back.
    """
    scratch_root(df.sparkSession)
    placed = _position(df.orderBy(group, *key), "__at")
    starts = placed.groupBy(group).agg(F.min("__at").alias("__start"))
    located = lookup_join(placed, starts, [group], how="inner", spread=["__at"])
    return located.withColumn(name, F.col("__at") - F.col("__start")).select(*df.columns, name)
