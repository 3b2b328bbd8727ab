"""Parquet outputs with declared schemas.

A table is written beside its path first, as a version of its own. One that is new takes
its place by a single rename. One that replaces another is published by a pointer: a
small file beside the path that appears by one rename and names the new version. From
then on :func:`current` finds the new rows and before it the old ones, whatever fails and
when; the renames that follow only bring the version to its path, for readers that know
nothing of pointers, and the next writer finishes what a lost driver left. A path has one
writer at a time. A version that was never published stays beside the path, hidden from
Spark's readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPRESSION = "zstd"

UNIQUE_SCHEMA = (
    "source_index bigint, source_text string, ambiguity tinyint, processed_text string"
)
SCORED_SCHEMA = (
    "source_index bigint, source_text string, ambiguity tinyint, sentence1 string, "
    "sentence2 string, prediction string, equivalent_prob double, neutral_prob double, "
    "contradiction_prob double, is_equivalent boolean, nli_model string, "
    "nli_revision string"
)


def to_schema(df: DataFrame, schema: str) -> DataFrame:
    """Columns in declared order and type; values that do not fit stop the job."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is at ``path``, on any filesystem Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str, encoded: bool = False) -> None:
    """Remove a file or folder; ``encoded`` paths are URIs as Spark reports them."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if encoded else path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def state_path(path: str) -> str:
    return f"{path}.state.json"


def ensure_available(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Refuse an output that exists; an old state file counts as existing."""
    found = [p for p in (path, state_path(path), pointer_path(path)) if exists(spark, p)]
    if found and not overwrite:
        raise FileExistsError(f"Refusing to replace {', '.join(found)}")


def _beside(path: str, kind: str) -> str:
    parent, _, base = path.rstrip("/").rpartition("/")
    return f"{parent}/_{base}-{kind}" if parent else f"_{base}-{kind}"


def pointer_path(path: str) -> str:
    """Where the pointer of a table is while it is being replaced."""
    return _beside(path, "next.json")


@contextmanager
def replacing(spark: SparkSession, path: str, overwrite: bool) -> Iterator[str]:
    """A place to write what becomes ``path`` when the block ends without an error."""
    ensure_available(spark, path, overwrite)
    new = _beside(path, f"new-{uuid.uuid4().hex}")
    try:
        yield new
    except BaseException:
        delete(spark, new)
        raise
    publish(spark, new, path)


def publish(spark: SparkSession, new: str, path: str) -> None:
    """Let ``path`` be the rows at ``new``, which were written completely."""
    path = path.rstrip("/")
    recover(spark, path)
    if exists(spark, path):
        place = {"new": new, "old": _beside(path, f"old-{uuid.uuid4().hex}")}
        put(spark, pointer_path(path), json.dumps(place))
        _finish(spark, path, place)
    else:
        rename(spark, new, path)
    if exists(spark, state_path(path)):
        delete(spark, state_path(path))


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows of ``path`` now."""
    place = _pointed(spark, path)
    return place["new"] if place and exists(spark, place["new"]) else path


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that a writer left after publishing it."""
    if place := _pointed(spark, path):
        _finish(spark, path.rstrip("/"), place)


def _pointed(spark: SparkSession, path: str) -> dict[str, str] | None:
    pointer = pointer_path(path)
    if not exists(spark, pointer):
        return None
    return json.loads(get(spark, pointer))


def _finish(spark: SparkSession, path: str, place: dict[str, str]) -> None:
    if exists(spark, place["new"]):
        if exists(spark, path):
            rename(spark, path, place["old"])
        try:
            rename(spark, place["new"], path)
        except BaseException:
            # The old rows go back where plain readers look; the pointer still has the new ones.
            rename(spark, place["old"], path)
            raise
    delete(spark, pointer_path(path))
    delete(spark, place["old"])


def put(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears with its whole content, by a rename."""
    jvm, draft = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    target = jvm.org.apache.hadoop.fs.Path(draft)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename(spark, draft, path)


def get(spark: SparkSession, path: str) -> str:
    """The content of a small file; Spark's readers pass hidden ones over."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    stream = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(source)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def entries(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that match a pattern, sorted."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(status.getPath().getName() for status in found or [])


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    one, two = (jvm.org.apache.hadoop.fs.Path(path) for path in (source, target))
    if not one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(one, two):
        raise OSError(f"Could not rename {source} to {target}")


def write_table(
    df: DataFrame, path: str, schema: str | None = None, overwrite: bool = False
) -> None:
    """One table at ``path``; an existing one is refused or replaced."""
    table = to_schema(df, schema) if schema else df
    with replacing(df.sparkSession, path, overwrite) as new:
        table.write.mode("errorifexists").option("compression", COMPRESSION).parquet(new)


def write_unique(df: DataFrame, path: str) -> None:
    """The unique translation table; always replaces."""
    write_table(df, path, UNIQUE_SCHEMA, overwrite=True)


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(current(spark, path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
