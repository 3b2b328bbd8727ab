"""Raw archives to candidate tables, one folder per archive."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambilens.operators.archive import (
    CANDIDATE_SCHEMA,
    archive_errors,
    candidates_per_path,
    carry_metadata,
    flatten_candidates,
)
from ambilens.operators.skew import lookup_join
from ambilens.session import scratch_path, stage
from ambilens.sinks.tables import COMPRESSION, delete, read_or_none, to_schema
from ambilens.sources.archive import (
    END_OF_FILE,
    SPAN,
    SPLIT_BYTES,
    SUFFIX,
    TABLE_SUFFIX,
    read_spans,
    record_schema,
    spans_of,
)
from ambilens.sources.listing import FILE, TABLE, list_tree

STATUS_SCHEMA = (
    "path string, folder string, model_tag string, status string, n_rows bigint, "
    "n_samples bigint, error string, run_id string"
)
#: What extraction reads of stored record tables, which hold more.
STORED_SCHEMA = record_schema(tokens=False).replace("path string, ", "").replace(", error string", "").replace("is_text:boolean, ", "")
WRITTEN, SKIPPED, FAILED = "written", "skipped", "failed"
RECORD_COLUMNS = ("path", "seq", "type", "config", "samples")
#: Candidates of an archive beyond which several tasks write it.
ROWS_PER_FILE = 500_000
CONFIG_FIELDS = ("model", "model_type", "dataset", "json")


def read_records(
    spark: SparkSession, path: str, tokens: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Archive records; see :mod:`ambilens.sources.archive`.

    Files above ``split_bytes`` are read by several tasks and stored; those whose
    parts don't chain are read again as a whole, so the rows are the same at any
    ``split_bytes``. Only ``seq`` differs: it orders the records of a path.
    """
    files = list_tree(spark, path).where(F.col("kind") == FILE)
    return _read(files.select("path", "size"), tokens, split_bytes)


def _read(files: DataFrame, tokens: bool, split_bytes: int) -> DataFrame:
    """Records of ``path, size``, which should be a stored table."""
    large = files.where(F.col("size") > split_bytes)
    whole = files.where(F.col("size") <= split_bytes)
    if large.isEmpty():
        return read_spans(spans_of(whole, split_bytes), tokens)
    parts = stage(read_spans(spans_of(large, split_bytes), tokens), "records")
    broken = stage(broken_chains(parts), "broken")  # a row per file
    rows = parts.where(F.col("type").isNull() | (F.col("type") != SPAN))
    rows = rows.join(broken, "path", "left_anti").select(*parts.columns)
    again = whole.unionByName(large.join(broken, "path", "left_semi").select(*whole.columns))
    return rows.unionByName(read_spans(spans_of(again, 1 << 62), tokens))


def broken_chains(parts: DataFrame) -> DataFrame:
    """Paths of split files whose spans don't chain from the first byte to the last.

    A path has one fact row per span, in order of ``seq``; a span in which no member
    starts only passes the chain on.
    """
    facts = parts.where(F.col("type") == SPAN).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct(
            "seq", F.col("start_index").alias("first"), F.col("end_index").alias("following"), "error"
        ))).alias("spans")
    )

    def link(state: Column, span: Column) -> Column:
        sound = span["error"].isNull() & (span["first"].isNull() | (span["first"] == state["at"]))
        return F.struct(
            F.coalesce(span["following"], state["at"]).alias("at"), (state["sound"] & sound).alias("sound")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("sound"))
    chained = F.aggregate("spans", start, link, lambda state: state["sound"] & (state["at"] == END_OF_FILE))
    return facts.where(~chained).select("path")


def read_stored_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of all tables below ``root`` that :func:`ambilens.plans.sampling.write_archive`
    stored, one path per table."""
    stored = (
        spark.read.schema(STORED_SCHEMA).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").parquet(root)
    )
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(file, rf"^(.*{TABLE_SUFFIX.replace('.', '[.]')})/[^/]*$", 1)
    return stored.withColumn("path", F.regexp_replace(folder, "^file:/+", "/")).where("path <> ''")


def mirrored(path: Column, root: str) -> list[Column]:
    """Output place of an archive: its folder below the root, and its tag."""
    root = root.rstrip("/")
    relative = F.substring(path, len(root) + 2, 1 << 30)
    outside = F.raise_error(F.concat(path, F.lit(f" is not below {root}"))).cast("string")
    relative = (
        F.when(F.startswith(path, F.lit(root + "/")), relative)
        .when(path == root, F.substring_index(path, "/", -1))
        .otherwise(outside)
    )
    name = F.substring_index(relative, "/", -1)
    folder = F.substring(relative, F.lit(1), F.length(relative) - F.length(name) - 1)
    endings = "|".join(ending.replace(".", "[.]") for ending in (SUFFIX, TABLE_SUFFIX))
    return [
        F.when(folder == "", ".").otherwise(folder).alias("folder"),
        F.regexp_replace(name, f"({endings})$", "").alias("model_tag"),
    ]


def archive_status(records: DataFrame, root: str) -> DataFrame:
    """Per archive: written or failed, row and sample counts, and the error."""
    sizes = candidates_per_path(records.where(F.col("type") == "batch"))
    errors = archive_errors(records)
    failed = F.col("reason").isNotNull()
    detail = F.col("reason")
    if "error" in records.columns:
        said = records.where(F.col("error").isNotNull()).groupBy("path").agg(
            F.min_by("error", "seq").alias("said")
        )
        errors = errors.join(said, "path", "left")
        detail = F.concat_ws(": ", "reason", F.when(
            F.col("reason") == "unreadable record", F.col("said")
        ))
    return errors.join(sizes, "path", "left").select(
        "path",
        *mirrored(F.col("path"), root),
        F.when(failed, FAILED).otherwise(WRITTEN).alias("status"),
        F.when(failed, 0).otherwise(F.coalesce("n_rows", F.lit(0))).cast("bigint").alias("n_rows"),
        F.when(failed, 0)
        .otherwise(F.coalesce("n_samples", F.lit(0)))
        .cast("bigint")
        .alias("n_samples"),
        F.when(failed, detail).alias("error"),
    )


def status_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(
        F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows")
    )


def extract_archives(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    overwrite: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Extract all archives below ``input_dir``; returns the status of every one.

    Archives are ``*.pkl.gz`` files and ``*.records`` tables, as sampling stores them.
    Rows go to ``output_dir`` partitioned by folder and model tag, statuses to
    ``output_dir/_status``. An archive with any bad record is left out as a whole
    and reported; one that was written before is skipped unless ``overwrite``.
    Archives are decoded once, into a staged table. An archive without candidates
    counts as written; it has no partition. Folders are listed and files read by the
    tasks; the statuses returned are those stored.
    """
    input_dir = input_dir.rstrip("/")
    listed = stage(list_tree(spark, input_dir), "listed")
    if listed.isEmpty():
        raise FileNotFoundError(f"No {SUFFIX} files under {input_dir}")
    status_dir, run_id = f"{output_dir.rstrip('/')}/_status", uuid.uuid4().hex
    done = None if overwrite else read_or_none(spark, status_dir, STATUS_SCHEMA)
    skipped = _skipped(listed.limit(0), input_dir)
    if done is not None:
        written = done.where(F.col("status") == WRITTEN).select("path").distinct()
        skipped = _skipped(listed.join(written, "path", "left_semi"), input_dir)
        listed = listed.join(written, "path", "left_anti")
    todo = stage(listed, "todo")
    if todo.isEmpty():
        return skipped

    folder = scratch_path(spark, "extract")
    files = todo.where(F.col("kind") == FILE).select("path", "size")
    parts = [_read(files, False, split_bytes).select(*RECORD_COLUMNS, "error")]
    tables = todo.where(F.col("kind") == TABLE).select("path")
    if not tables.isEmpty():
        config = F.struct(*[F.col(f"config.{name}") for name in CONFIG_FIELDS])
        stored = read_stored_records(spark, input_dir).join(tables, "path", "left_semi")
        stored = stored.withColumn("config", F.when(F.col("config").isNotNull(), config))
        parts.append(_text_records(stored).withColumn("error", F.lit(None).cast("string")))
    records = stage(reduce(DataFrame.unionByName, parts), path=f"{folder}/records")
    status = stage(_with_silent(archive_status(records, input_dir), todo.select("path"), input_dir), path=f"{folder}/status")
    sound = status.where(F.col("status") == WRITTEN)
    # Split files are numbered by byte offset and record, whole files by record.
    batches = carry_metadata(records, chunk=max(split_bytes << 10, 4096))
    # A partition's rows meet in one task, or in as many as its rows ask for: a file each, not
    # one from every task that read a part of the archive.
    files = F.greatest(F.ceil(F.col("n_rows") / ROWS_PER_FILE), F.lit(1)).alias("__files")
    places = sound.select("path", "folder", "model_tag", files)
    batches = lookup_join(batches, places, ["path"], how="inner", spread=["seq"])
    batches = batches.repartition("folder", "model_tag", F.pmod(F.xxhash64("path", "seq"), F.col("__files")))
    rows = flatten_candidates(batches, keep=["folder", "model_tag"])
    schema = f"folder string, model_tag string, {CANDIDATE_SCHEMA}"
    if overwrite:
        _clear(spark, output_dir, sound.where("n_rows = 0"))
    (
        to_schema(rows, schema)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy("folder", "model_tag")
        .parquet(output_dir)
    )
    (
        status.withColumn("run_id", F.lit(run_id))
        .write.mode("append")
        .option("compression", COMPRESSION)
        .parquet(status_dir)
    )
    told = read_or_none(spark, status_dir, STATUS_SCHEMA).where(F.col("run_id") == run_id).drop("run_id")
    delete(spark, folder)
    return told.unionByName(skipped)


def _text_records(stored: DataFrame) -> DataFrame:
    """Stored records with the text-level payload only, as the archive source gives it."""

    def candidate(c: Column) -> Column:
        return F.struct(c["text"].alias("text"), F.lit(True).alias("is_text"), c["finish_reason"].alias("finish_reason"))

    def sample(s: Column) -> Column:
        return F.struct(
            *[s[name].alias(name) for name in ("index", "row_number", "src", "ambiguity")],
            F.transform(s["candidates"], candidate).alias("candidates"),
        )

    return stored.withColumn("samples", F.transform("samples", sample)).select(*RECORD_COLUMNS)


def _with_silent(status: DataFrame, listed: DataFrame, root: str) -> DataFrame:
    """Add archives that hold no record at all."""
    nothing = F.lit(0).cast("bigint")
    return status.unionByName(listed.join(status, "path", "left_anti").select(
        "path", *mirrored(F.col("path"), root), F.lit(FAILED).alias("status"),
        nothing.alias("n_rows"), nothing.alias("n_samples"),
        F.lit("no metadata record").alias("error"),
    ))


def _skipped(listed: DataFrame, root: str) -> DataFrame:
    nothing = F.lit(0).cast("bigint")
    return listed.select(
        "path", *mirrored(F.col("path"), root), F.lit(SKIPPED).alias("status"),
        nothing.alias("n_rows"), nothing.alias("n_samples"),
        F.lit(None).cast("string").alias("error"),
    )


def _clear(spark: SparkSession, output_dir: str, emptied: DataFrame) -> None:
    """Drop the old files of archives that no longer have candidates.

    Dynamic overwrite replaces only partitions that receive rows.
    """
    # Reading the table lists its folders, one for each archive.
    if emptied.isEmpty():
        return
    old = read_or_none(spark, output_dir, f"{CANDIDATE_SCHEMA}, folder string, model_tag string")
    if old is None:
        return
    stale = old.select("folder", "model_tag", F.col("_metadata.file_path").alias("file"))
    stale = stale.join(emptied.select("folder", "model_tag"), ["folder", "model_tag"], "left_semi")
    for row in stale.select("file").distinct().toLocalIterator():
        delete(spark, row.file, encoded=True)


def read_candidates(spark: SparkSession, output_dir: str) -> DataFrame:
    """The extracted table with its ``folder`` and ``model_tag``."""
    schema = f"{CANDIDATE_SCHEMA}, folder string, model_tag string"
    found = read_or_none(spark, output_dir, schema)
    if found is None:
        raise FileNotFoundError(f"No extracted table at {output_dir}")
    return found

