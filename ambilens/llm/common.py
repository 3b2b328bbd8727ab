"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of text that a Python task turns into arrays at a time.
CHUNK_CHARS = 1 << 20

RANK_BUCKETS = 4096


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_mod(column: str, modulus: int) -> Column:
    """CRC-32 of the column as text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for at, size in enumerate(sizes):
        if at > begin and total + size > limit:
            yield batch.slice(begin, at - begin)
            begin, total = at, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def rank_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: Column | None = None
) -> DataFrame:
    """Number the rows of each group from 0, without a task that sees a whole group.

    Rows of a group spread over buckets, by a hash of the order columns and of the
    partition they are read in, so that equal rows spread as well. The counts of the
    buckets (at most ``RANK_BUCKETS`` rows a group) give each bucket its first number;
    within a bucket, rows are numbered by the order columns. Equal rows get different
    numbers. ``df`` is read twice, so it has to be a stored table, with nothing but
    projections and broadcast joins behind it. ``buckets`` is the number for the row's
    group where it is known to need fewer.
    """
    hashed = F.xxhash64(*[F.col(c) for c in order], F.spark_partition_id())
    count = F.lit(RANK_BUCKETS) if buckets is None else F.least(buckets, F.lit(RANK_BUCKETS))
    dealt = df.withColumn("__bucket", F.pmod(hashed, count).cast("int"))
    keys = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy(*keys).agg(F.count("*").alias("__n"))
        .withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        dealt.join(first, keys)
        .withColumn(name, F.col("__first") + F.row_number().over(within) - 1)
        .drop("__first", "__bucket")
    )
