"""Translation sampling around an outside generator: prompts out, archive in.

``translation_requests`` is the table a generator reads; ``sample_records`` turns
its completions into the records of a raw archive, stored as a nested table that
the extraction reads like an archive file.
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.functions.names import model_tag, resolve_model_type
from ambilens.functions.prompts import translation_prompt
from ambilens.functions.tokens import candidate
from ambilens.operators.archive import BATCH_BYTES, METADATA, batch_records
from ambilens.sinks.tables import write_table
from ambilens.sources.archive import TABLE_SUFFIX

BATCH_SIZE = 128
CONFIG = "struct<model:string, model_type:string, dataset:string, json:string>"


def translation_requests(
    corpus: DataFrame,
    model: str,
    requested_type: str = "auto",
    has_chat_template: bool = False,
    render: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Corpus rows with the prompt of a model; ``index`` is the request id."""
    kind = resolve_model_type(F.lit(model), has_chat_template, requested_type)
    typed = corpus.withColumns({"model": F.lit(model), "model_type": kind})
    return typed.withColumn("prompt", translation_prompt("src", "model_type", render))


def completion_candidates(completions: DataFrame, texts: Column | None = None) -> DataFrame:
    """Generator rows ``index, candidate_index, text, cumulative_logprob, token_ids,
    logprobs, finish_reason, stop_reason`` as archive candidates."""
    made = candidate(
        "text", "cumulative_logprob", "token_ids", "logprobs", "finish_reason", "stop_reason", texts
    )
    return completions.select("index", "candidate_index", made.alias("candidate"))


def samples(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per request with its candidates in order.

    A request has as many candidates as were sampled for it, a fixed small number.
    A request without any stops the job.
    """
    listed = candidates.groupBy("index").agg(
        F.sort_array(F.collect_list(F.struct("candidate_index", "candidate"))).alias("__c")
    )
    stop = F.raise_error(F.concat(F.lit("No completion for request "), F.col("index")))
    ordered = F.transform("__c", lambda c: c["candidate"])
    kind = candidates.schema["candidate"].dataType.simpleString()
    found = F.when(F.col("__c").isNull(), stop.cast(f"array<{kind}>")).otherwise(ordered)
    return requests.join(listed, "index", "left").select(
        "index", "row_number", "src", "ambiguity", "prompt", found.alias("candidates")
    )


def sample_records(
    sampled: DataFrame, config: dict[str, Any], batch_size: int = BATCH_SIZE, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Records of one model's archive: the metadata record, then its batches in order of index."""
    spark = sampled.sparkSession
    batches = batch_records(sampled, batch_size, batch_bytes=batch_bytes)
    kind = batches.schema["samples"].dataType.simpleString()
    model = F.lit(str(config.get("model", "")))
    nothing = F.lit(None)
    stored = batches.select(
        model_tag(model).alias("path"),
        (F.col("start_index") + 1).alias("seq"), "type",
        nothing.cast("double").alias("created_at"), nothing.cast("string").alias("hostname"),
        nothing.cast(CONFIG).alias("config"), "start_index", "end_index", "samples",
    )
    described = F.struct(
        model.alias("model"),
        F.lit(str(config.get("model_type", ""))).alias("model_type"),
        F.lit(config.get("dataset")).cast("string").alias("dataset"),
        F.lit(json.dumps(config, ensure_ascii=False)).alias("json"),
    )
    head = spark.range(1).select(
        model_tag(model).alias("path"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(METADATA).alias("type"), F.lit(time.time()).alias("created_at"),
        F.lit(socket.gethostname()).alias("hostname"), described.alias("config"),
        nothing.cast("bigint").alias("start_index"), nothing.cast("bigint").alias("end_index"),
        nothing.cast(kind).alias("samples"),
    )
    return head.unionByName(stored)


def write_archive(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store records as a nested table; an existing archive is refused or replaced.

    ``path`` ends in ``.records``, by which the extraction finds the table.
    """
    if not path.endswith(TABLE_SUFFIX):
        raise ValueError(f"The path of a stored archive ends in {TABLE_SUFFIX}: {path}")
    write_table(records, path, overwrite=overwrite)
