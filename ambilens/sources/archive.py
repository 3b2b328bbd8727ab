"""Raw archives ``*.pkl.gz`` as a Spark data source.

A file is a run of gzip members with pickled records: plain dicts, lists, strings,
numbers and null. Classes and functions are refused, so reading runs no code from
the file. Tasks stream records, one in memory at a time. A failed file gives one
row with ``error`` and does not stop the others.

Options: ``path`` (folder or file; any filesystem Arrow can open), ``paths`` (a JSON
list of files, instead), ``tokens``
(``true`` adds the token-level payload), ``split_bytes`` (files larger than this
are read by several tasks, each taking the members that start in its range).

A split file also gives one row of type ``span`` per task: where its first member
starts (``start_index``) and where the one after its last would (``end_index``, -1 at
the end of the file), or an ``error``. Only where these facts chain from the file's
first byte to its last did the tasks read what a single pass reads; any other file
(records across members, a corrupt or truncated member, a refused class) has to be
read again as a whole. ``ambilens.plans.extract.read_records`` does both.

Usage::

    register(spark)
    spark.read.format("gzip_records").option("path", folder).load()
"""

from __future__ import annotations

import gzip
import io
import json
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

SUFFIX = ".pkl.gz"
TABLE_SUFFIX = ".records"
FORMAT = "gzip_records"
SPLIT_BYTES = 256 * 1024 * 1024
_MEMBER = b"\x1f\x8b\x08"
_READ = 1024 * 1024
#: Candidates that a task gathers before it hands on records, and bytes of files per task.
HANDED_CANDIDATES, TASK_BYTES = 4096, 128 * 1024 * 1024
MAX_TASKS = 50_000
SPAN = "span"
END_OF_FILE = -1
# Records of one member are numbered below these bits.
_RECORD_BITS = 16

_TEXT_CANDIDATE = "text string, is_text boolean, finish_reason string"
_TOKEN_CANDIDATE = (
    _TEXT_CANDIDATE + ", cumulative_logprob double, token_ids array<int>, "
    "tokens array<struct<token_id int, token string, sampled_logprob double, "
    "top array<struct<token_id int, token string, logprob double, rank int>>>>, "
    "stop_reason string"
)


def record_schema(tokens: bool) -> str:
    candidate = _TOKEN_CANDIDATE if tokens else _TEXT_CANDIDATE
    candidate = candidate.replace(" string", ":string").replace(" boolean", ":boolean")
    candidate = candidate.replace(" double", ":double").replace(" int", ":int")
    candidate = candidate.replace(" array", ":array")
    prompt = ", prompt:string" if tokens else ""
    return (
        "path string, seq bigint, type string, created_at double, hostname string, "
        "config struct<model:string, model_type:string, dataset:string, json:string>, "
        "start_index bigint, end_index bigint, "
        "samples array<struct<index:bigint, row_number:bigint, src:string, "
        f"ambiguity:int{prompt}, candidates:array<struct<{candidate}>>>>, "
        "error string"
    )


class PlainUnpickler(pickle.Unpickler):
    """Unpickler for plain values: any class or function reference is refused."""

    def find_class(self, module: str, name: str) -> Any:
        raise pickle.UnpicklingError(f"Refused to load {module}.{name}")


@dataclass(frozen=True)
class Span(InputPartition):
    path: str
    start: int
    end: int
    whole: bool


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def _integer(value: Any, bits: int = 64) -> int | None:
    """An integer of the given width; anything else fails the file."""
    if value is None:
        return None
    number = int(value)
    if number != value or not -(1 << bits - 1) <= number < 1 << bits - 1:
        raise ValueError(f"{value!r} is no {bits}-bit integer")
    return number


def _number(value: Any, kind: type) -> Any:
    return None if value is None else kind(value)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.paths = json.loads(options.get("paths", "[]"))
        self.tokens = options.get("tokens", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take equalities on ``path`` and ``type``: other files aren't opened, and other
        records are passed over before their samples become rows.

        Facts of split files and errors are handed on whatever type is asked for, and Spark
        checks types again.
        """
        for one in filters:
            column = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if column in ("path", "type") and isinstance(one, (EqualTo, In)):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            if column != "path" or not isinstance(one, (EqualTo, In)):
                yield one

    def partitions(self) -> list[InputPartition]:
        spans: list[InputPartition] = []
        listed = self.paths or [self.path]
        for path, size in (entry for item in listed for entry in list_archives(item)):
            if "path" in self.wanted and path not in self.wanted["path"]:
                continue
            if size <= self.split_bytes:
                spans.append(Span(path, 0, size, True))
                continue
            for start in range(0, size, self.split_bytes):
                spans.append(Span(path, start, min(start + self.split_bytes, size), False))
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return self._read_whole(partition) if partition.whole else self._read_span(partition)

    def _read_whole(self, partition: Span) -> Iterator[tuple]:
        seq = -1
        try:
            source, inner = open_filesystem(partition.path)
            with source.open_input_file(inner) as stream:
                for seq, record in _whole(stream):
                    if self._asked_for(record):
                        yield self._row(partition.path, seq, record)
        except Exception as error:  # a bad file must not stop the other files
            yield self._failure(partition.path, seq + 1, f"{type(error).__name__}: {error}")

    def _asked_for(self, record: Any) -> bool:
        wanted = self.wanted.get("type")
        return wanted is None or not isinstance(record, dict) or _text(record.get("type")) in wanted

    def _read_span(self, span: Span) -> Iterator[tuple]:
        """Records of the members that start inside the span, then the span's facts."""
        first = at = None
        problem = None
        try:
            source, inner = open_filesystem(span.path)
            with source.open_input_file(inner) as stream:
                first = at = 0 if span.start == 0 else _next_member(stream, span.start, span.end)
                while at is not None and END_OF_FILE < at < span.end:
                    member = _Member(stream, at)
                    for number, record in enumerate(_records(member)):
                        if number >> _RECORD_BITS:
                            raise ValueError("Too many records in one member")
                        yield self._row(span.path, at << _RECORD_BITS | number, record)
                    at = member.following()
        except Exception as error:  # the file is read again as a whole
            problem = f"{type(error).__name__}: {error}"
        yield (span.path, span.start, SPAN, None, None, None, first, at, None, problem)

    def _failure(self, path: str, seq: int, message: str) -> tuple:
        return (path, seq, None, None, None, None, None, None, None, message)

    def _row(self, path: str, seq: int, record: Any) -> tuple:
        if not isinstance(record, dict):
            raise ValueError("Expected a dictionary record")
        config = record.get("config")
        flat = None
        if isinstance(config, dict):
            flat = (
                str(config.get("model", "")),
                str(config.get("model_type", "")),
                _text(config.get("dataset")),
                json.dumps(config, ensure_ascii=False, default=str),
            )
        samples = None
        if "samples" in record:
            samples = [self._sample(sample) for sample in record["samples"] or ()]
        return (
            path, seq, _text(record.get("type")),
            _number(record.get("created_at"), float), _text(record.get("hostname")),
            flat, _integer(record.get("start_index")),
            _integer(record.get("end_index")), samples, None,
        )

    def _sample(self, sample: dict[str, Any]) -> tuple:
        head = (
            _integer(sample.get("index")), _integer(sample.get("row_number")),
            _text(sample.get("src", "")), _integer(sample.get("ambiguity"), 8),
        )
        if self.tokens:
            head += (_text(sample.get("prompt")),)
        return (*head, [self._candidate(c) for c in sample.get("candidates") or ()])

    def _candidate(self, candidate: dict[str, Any]) -> tuple:
        text = candidate.get("text", "")
        row = (str(text), isinstance(text, str), _text(candidate.get("finish_reason")))
        if not self.tokens:
            return row
        return (
            *row,
            _number(candidate.get("cumulative_logprob"), float),
            [int(i) for i in candidate.get("token_ids") or ()],
            [
                (
                    _integer(token.get("token_id"), 32),
                    _text(token.get("token")),
                    _number(token.get("sampled_logprob"), float),
                    None if token.get("top") is None else [
                        (
                            _integer(alt.get("token_id"), 32),
                            _text(alt.get("token")),
                            _number(alt.get("logprob"), float),
                            _integer(alt.get("rank"), 32),
                        )
                        for alt in token["top"]
                    ],
                )
                for token in candidate.get("tokens") or ()
            ],
            _text(candidate.get("stop_reason")),
        )


def _whole(stream: BinaryIO) -> Iterator[tuple[int, Any]]:
    """Records of a file in order, numbered from 0."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as plain:
        yield from enumerate(_records(plain))


def _records(plain: Any) -> Iterator[Any]:
    buffered = io.BufferedReader(plain)
    while buffered.peek(1):
        yield PlainUnpickler(buffered).load()


class _Member(io.RawIOBase):
    """The plain bytes of the gzip member at ``start``, inflated as they are read."""

    def __init__(self, stream: BinaryIO, start: int) -> None:
        self._stream, self._at = stream, start
        self._inflater = zlib.decompressobj(wbits=zlib.MAX_WBITS | 16)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: Any) -> int:
        while not self._inflater.eof:
            block = self._inflater.unconsumed_tail
            if not block:
                self._stream.seek(self._at)
                block = self._stream.read(_READ)
                if not block:
                    raise EOFError("Truncated archive member")
                self._at += len(block)
            plain = self._inflater.decompress(block, len(buffer))
            if plain:
                buffer[: len(plain)] = plain
                return len(plain)
        return 0

    def following(self) -> int:
        """Where the next member starts, once this one is drained."""
        at = self._at - len(self._inflater.unused_data)
        self._stream.seek(at)
        return at if self._stream.read(1) else END_OF_FILE


def _next_member(stream: BinaryIO, start: int, end: int) -> int | None:
    """First place in the range where a whole member with a valid checksum starts.

    Compressed data may hold a member's signature by chance, and a damaged member
    may be passed over: the chain of facts tells.
    """
    position = start
    while position < end:
        stream.seek(position)
        window = stream.read(min(_READ, end - position) + len(_MEMBER) - 1)
        found = window.find(_MEMBER)
        while found >= 0 and position + found < end:
            if _is_member(stream, position + found):
                return position + found
            found = window.find(_MEMBER, found + 1)
        position += _READ
    return None


def _is_member(stream: BinaryIO, at: int) -> bool:
    member = _Member(stream, at)
    buffer = bytearray(_READ)
    try:
        while member.readinto(buffer):
            pass
    except (zlib.error, EOFError):
        return False
    return True


def open_filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


def list_archives(path: str) -> list[tuple[str, int]]:
    """Archives at or below ``path``, sorted, with their sizes."""
    return [(found, size) for found, size in _listed(path, directories=False) if found.endswith(SUFFIX)]


def list_tables(path: str) -> list[str]:
    """Stored record tables (folders) at or below ``path``, sorted."""
    return [found for found, _ in _listed(path, directories=True) if found.endswith(TABLE_SUFFIX)]


def _listed(path: str, directories: bool) -> list[tuple[str, int]]:
    """Entries at or below ``path`` under the scheme and authority it was given with."""
    path = path.rstrip("/")
    source, inner = open_filesystem(path)
    inner = inner.rstrip("/")
    if not path.endswith(inner):
        raise ValueError(f"Can't tell the store from the folder in {path}")
    prefix = path[: len(path) - len(inner)]
    info = source.get_file_info(inner)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"No archive folder {path}")
    found = [info]
    if info.type == arrow_fs.FileType.Directory:
        found += source.get_file_info(arrow_fs.FileSelector(inner, recursive=True))
    wanted = arrow_fs.FileType.Directory if directories else arrow_fs.FileType.File
    return sorted((prefix + entry.path, entry.size) for entry in found if entry.type == wanted)


def spans_of(files: DataFrame, split_bytes: int) -> DataFrame:
    """``path, start, end, whole`` from ``path, size``: one row per range of a large file."""
    large = F.col("size") > split_bytes
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    cut = files.withColumn("start", F.explode(F.when(large, starts).otherwise(F.array(F.lit(0).cast("long")))))
    end = F.when(large, F.least(F.col("start") + split_bytes, F.col("size"))).otherwise(F.col("size"))
    return cut.select("path", "start", end.alias("end"), (~large).alias("whole"))


def read_spans(spans: DataFrame, tokens: bool = False) -> DataFrame:
    """Records of ``spans``, read by the tasks that the rows go to.

    Nothing about single files passes the driver: it learns the sum of the sizes only.
    """
    size, rows = spans.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(rows, MAX_TASKS, max(-(-size // TASK_BYTES), spans.sparkSession.sparkContext.defaultParallelism)))
    text = record_schema(tokens)
    schema = to_arrow_schema(T.StructType.fromDDL(text))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RecordReader({"tokens": str(tokens)})
        for batch in batches:
            for row in batch.to_pylist():
                held, candidates = [], 0
                for record in reader.read(Span(**row)):
                    held.append(record)
                    candidates += sum(len(sample[-1]) for sample in record[-2] or ())
                    if candidates >= HANDED_CANDIDATES or len(held) >= HANDED_CANDIDATES:
                        yield made(held)
                        held, candidates = [], 0
                if held:
                    yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(column), field.type) for column, field in zip(zip(*held), schema)], schema=schema
        )

    return spans.repartition(tasks, "path", "start").mapInArrow(read, text)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return record_schema(self.options.get("tokens", "false").lower() == "true")

    def reader(self, schema: Any) -> RecordReader:
        return RecordReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, whose filters may then reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
