"""Folder trees listed by executors: one row per archive, none of them on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambilens.session import stage
from ambilens.sources.archive import SUFFIX, TABLE_SUFFIX, open_filesystem

LISTED = "path string, size long, kind string"
FILE, TABLE, FOLDER = "file", "table", "folder"
ROWS, MAX_TASKS = 10_000, 10_000


def list_folder(path: str) -> Iterator[tuple[str, int, str]]:
    """Archives, stored record tables and folders directly in a folder."""
    source, inner = open_filesystem(path.rstrip("/"))
    inner = inner.rstrip("/")
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(inner)]
    for entry in source.get_file_info(arrow_fs.FileSelector(inner)):
        if entry.type == arrow_fs.FileType.Directory:
            yield prefix + entry.path, 0, TABLE if entry.path.endswith(TABLE_SUFFIX) else FOLDER
        elif entry.path.endswith(SUFFIX):
            yield prefix + entry.path, entry.size, FILE


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, kind`` of archives (``file``) and stored tables (``table``) below ``root``.

    The tree is listed level by level: the folders of a level are rows, dealt to tasks. A
    root that is an archive itself is the one row; one that doesn't exist is an error.
    """
    root = root.rstrip("/")
    source, inner = open_filesystem(root)
    inner = inner.rstrip("/")
    if not root.endswith(inner):
        raise ValueError(f"Can't tell the store from the folder in {root}")
    info = source.get_file_info(inner)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"No archive folder {root}")
    if info.type == arrow_fs.FileType.File:
        return spark.createDataFrame([(root, info.size, FILE)] if root.endswith(SUFFIX) else [], LISTED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = list(list_folder(folder))
                for at in range(0, len(found), ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found[at : at + ROWS]), (pa.string(), pa.int64(), pa.string()))],
                        ["path", "size", "kind"],
                    )

    folders, n, levels = spark.createDataFrame([(root,)], "path string"), 1, []
    while n:
        level = stage(folders.repartition(min(n, MAX_TASKS)).mapInArrow(read, LISTED), "listing")
        levels.append(level.where(F.col("kind") != FOLDER))
        folders = level.where(F.col("kind") == FOLDER).select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)
