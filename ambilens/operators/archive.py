"""Raw archive records: validity, metadata carry-forward, flattening, batching.

A record table has ``path, seq, type, config, samples`` (``seq`` orders the
records of a path) and, from the archive source, ``error``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ambilens.functions.text import clean_translation
from ambilens.operators.skew import fits_broadcast

METADATA, BATCH = "metadata", "batch"
CHUNK = 4096
#: Bytes of samples, as :func:`nested_bytes` counts them, that one batch record should hold.
BATCH_BYTES = 128 * 1024 * 1024

CANDIDATE_COLUMNS = (
    "source_index", "row_number", "source_text", "ambiguity", "model", "model_type",
    "candidate_index", "raw_text", "processed_text", "finish_reason",
)
CANDIDATE_SCHEMA = (
    "source_index bigint, row_number bigint, source_text string, ambiguity tinyint, "
    "model string, model_type string, candidate_index int, raw_text string, "
    "processed_text string, finish_reason string"
)


def archive_errors(records: DataFrame) -> DataFrame:
    """Per path: first error in record order (null if sound) and record counts.

    Conditional minima only, so a path of any size is reduced on the map side.
    """
    kind = F.col("type")
    known = F.coalesce(kind.isin(METADATA, BATCH), F.lit(False))
    unread = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    bad_config = (kind == METADATA) & F.col("config").isNull()
    seq = F.col("seq")
    facts = records.groupBy("path").agg(
        F.min(F.when(unread, seq)).alias("unread"),
        F.min(F.when(~unread & ~known, seq)).alias("unknown"),
        F.min(F.when(~unread & bad_config, seq)).alias("bad_config"),
        F.min(F.when(~unread & (kind == METADATA), seq)).alias("metadata"),
        F.min(F.when(~unread & (kind == BATCH), seq)).alias("batch"),
        F.count_if(~unread & (kind == BATCH)).alias("n_batches"),
    )
    orphan = F.col("batch") < F.col("metadata")
    orphan = F.when(F.coalesce(orphan, F.col("metadata").isNull()), F.col("batch"))
    first = F.least("unread", "unknown", "bad_config", orphan)
    reason = (
        F.when(first == F.col("unread"), "unreadable record")
        .when(first == F.col("unknown"), "unsupported record type")
        .when(first == F.col("bad_config"), "invalid metadata config")
        .when(first == orphan, "batch before metadata")
        .when(F.col("metadata").isNull(), "no metadata record")
    )
    return facts.select("path", reason.alias("reason"), first.alias("at_seq"), "n_batches")


def carry_metadata(
    records: DataFrame,
    chunk: int = CHUNK,
    broadcast_rows: int = 100_000,
    broadcast_bytes: int = 32 * 1024 * 1024,
) -> DataFrame:
    """Batch records with the config of the last metadata record before them.

    Metadata that measures small is broadcast as validity intervals, and the
    batches (which hold the payload) stay where they are. Otherwise both sides
    meet on (path, chunk of the sequence): no path has to fit in one task.
    Batches before any metadata keep a null config.
    """
    meta = records.where(F.col("type") == METADATA).select("path", "seq", "config")
    if fits_broadcast(meta, broadcast_rows, broadcast_bytes):
        return _carry_by_interval(records, meta)
    return _carry_by_chunk(records, meta, chunk)


def _carry_by_interval(records: DataFrame, meta: DataFrame) -> DataFrame:
    following = Window.partitionBy("path").orderBy("seq")
    spans = meta.select(
        F.col("path").alias("__path"),
        F.col("seq").alias("__from"),
        F.lead("seq").over(following).alias("__to"),
        F.col("config").alias("__config"),
    )
    batches = records.where(F.col("type") == BATCH).drop("config")
    inside = (
        (F.col("path") == F.col("__path"))
        & (F.col("seq") > F.col("__from"))
        & (F.col("__to").isNull() | (F.col("seq") < F.col("__to")))
    )
    return (
        batches.join(F.broadcast(spans), inside, "left")
        .withColumn("config", F.col("__config"))
        .drop("__path", "__from", "__to", "__config")
    )


def _carry_by_chunk(records: DataFrame, meta: DataFrame, chunk: int) -> DataFrame:
    place = F.floor(F.col("seq") / chunk).alias("__chunk")
    keys = ["path", "__chunk"]
    last = meta.groupBy("path", place).agg(
        F.max_by(F.struct("config"), F.col("seq")).alias("__last")
    )
    # One row per chunk that occurs: the window below sees 1/chunk of the records.
    chunks = records.select("path", place).distinct().join(last, keys, "left")
    earlier = Window.partitionBy("path").orderBy("__chunk")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        *keys, F.last("__last", ignorenulls=True).over(earlier).alias("__carried")
    )
    within = Window.partitionBy(*keys).orderBy("seq")
    within = within.rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col("type") == METADATA, F.struct("config"))
    seen = (
        records.withColumn("__chunk", place)
        .withColumn("__here", F.last(here, ignorenulls=True).over(within))
        .where(F.col("type") == BATCH)
    )
    return (
        seen.join(carried, keys, "left")
        .withColumn("config", F.coalesce("__here", "__carried")["config"])
        .drop("__chunk", "__here", "__carried")
    )


def _field(struct: Column, fields: Sequence[str], name: str, kind: str) -> Column:
    return struct[name].cast(kind) if name in fields else F.lit(None).cast(kind)


def flatten_candidates(batches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per candidate of batch records that carry their config.

    Missing or empty arrays give no rows. Missing text and source become "";
    a text that was no string (``is_text`` false) keeps its raw form and cleans
    to "".
    """
    sample_fields = batches.schema["samples"].dataType.elementType.fieldNames()
    candidates = batches.schema["samples"].dataType.elementType["candidates"]
    fields = candidates.dataType.elementType.fieldNames()
    samples = batches.select(*keep, "config", F.explode("samples").alias("s"))
    rows = samples.select(
        *keep, "config", "s", F.posexplode("s.candidates").alias("candidate_index", "c")
    )
    s, c = F.col("s"), F.col("c")
    is_text = F.coalesce(_field(c, fields, "is_text", "boolean"), F.lit(True))
    raw = F.coalesce(_field(c, fields, "text", "string"), F.lit(""))
    source = F.coalesce(_field(s, sample_fields, "src", "string"), F.lit(""))
    config_fields = batches.schema["config"].dataType.fieldNames()
    config = F.col("config")
    rows = rows.select(
        *keep,
        _field(s, sample_fields, "index", "bigint").alias("source_index"),
        _field(s, sample_fields, "row_number", "bigint").alias("row_number"),
        source.alias("source_text"),
        _field(s, sample_fields, "ambiguity", "tinyint").alias("ambiguity"),
        *[
            F.coalesce(_field(config, config_fields, name, "string"), F.lit("")).alias(name)
            for name in ("model", "model_type")
        ],
        F.col("candidate_index").cast("int").alias("candidate_index"),
        raw.alias("raw_text"),
        F.when(is_text, clean_translation(raw)).otherwise("").alias("processed_text"),
        _field(c, fields, "finish_reason", "string").alias("finish_reason"),
    )
    return rows.select(*keep, *CANDIDATE_COLUMNS)


def candidates_per_path(batches: DataFrame) -> DataFrame:
    """Candidate rows per archive, from array sizes alone."""
    per_batch = F.aggregate(
        F.transform(
            F.col("samples"), lambda s: F.coalesce(F.size(s["candidates"]), F.lit(0))
        ),
        F.lit(0).cast("long"),
        lambda acc, n: acc + F.greatest(n, F.lit(0)),
    )
    return batches.groupBy("path").agg(
        F.coalesce(F.sum(per_batch), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.greatest(F.size("samples"), F.lit(0))), F.lit(0)).alias("n_samples"),
    )


def nested_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: its texts, and 8 for any other leaf."""
    if isinstance(kind, T.StructType):
        parts = [nested_bytes(value[f.name], f.dataType) for f in kind.fields]
        return F.coalesce(reduce(Column.__add__, parts, F.lit(8).cast("long")), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        total = F.aggregate(
            value, F.lit(8).cast("long"), lambda acc, one: acc + nested_bytes(one, kind.elementType)
        )
        return F.coalesce(total, F.lit(8).cast("long"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return (F.coalesce(F.octet_length(value), F.lit(0)) + 8).cast("long")
    return F.lit(8).cast("long")


def batch_records(
    samples: DataFrame, batch_size: int = 128, keys: Sequence[str] = (), batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Group samples with an ``index`` into stored batch records.

    A group holds at most ``batch_size`` samples per key, by construction. One whose
    samples take more than ``batch_bytes`` is cut where their running size passes each
    multiple of it, so a record holds at most that and one sample.
    """
    fields = [name for name in samples.columns if name not in keys and name != "index"]
    slot = F.floor(F.col("index") / batch_size)
    sizes = [nested_bytes(F.col(f"`{name}`"), samples.schema[name].dataType) for name in fields]
    before = Window.partitionBy(*keys, "batch").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        samples.withColumn("batch", slot)
        .withColumn("__bytes", reduce(Column.__add__, sizes, F.lit(0).cast("long")))
        .withColumn("__part", F.floor(F.coalesce(F.sum("__bytes").over(before), F.lit(0)) / batch_bytes))
    )
    return (
        cut.groupBy(*keys, "batch", "__part")
        .agg(
            F.min("index").alias("start_index"),
            (F.max("index") + 1).alias("end_index"),
            F.sort_array(F.collect_list(F.struct("index", *fields))).alias("samples"),
        )
        .drop("__part")
        .withColumn("type", F.lit(BATCH))
    )
