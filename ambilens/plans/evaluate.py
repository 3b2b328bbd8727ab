"""The evaluation job: requests, generations, checks, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.functions.prompts import COMPARISON_TEMPLATES, IDENTIFICATION_TEMPLATES
from ambilens.operators import evaluation
from ambilens.sinks.report import write_report

IDENTIFICATION, COMPARISON = "identification", "comparison"


def report_header(
    task: str,
    model_id: str,
    dataset: str,
    mode: str = "default",
    sampling_config: dict[str, Any] | None = None,
) -> dict[str, Any]:
    """What a report says about its run. ``mode`` is default, cot or thinking."""
    style = "cot" if mode == "cot" else "default"
    templates = IDENTIFICATION_TEMPLATES if task == IDENTIFICATION else COMPARISON_TEMPLATES
    header: dict[str, Any] = {
        "model_id": model_id,
        "dataset": dataset,
        "prompt_style": style,
        "prompt_template": templates[style],
        "thinking": mode == "thinking",
    }
    if task == COMPARISON:
        header["evaluate_both_orders"] = True
    return header | {"sampling_config": dict(sampling_config or {})}


def evaluate(
    task: str,
    rows: DataFrame,
    generations: DataFrame,
    path: str,
    model_id: str,
    dataset: str,
    mode: str = "default",
    think_end_ids: Sequence[int] = (),
    texts: Column | None = None,
    render: Callable[[Column], Column] | None = None,
    sampling_config: dict[str, Any] | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Match generations to a corpus or to sentence pairs and write the report.

    Every request needs exactly one generation; otherwise nothing is written. Returns
    the counts of rows, of parsed answers and of right ones.
    """
    results = {IDENTIFICATION: evaluation.identification_results, COMPARISON: evaluation.comparison_results}
    if task not in results:
        raise ValueError(f"Unknown task {task!r}; known: {', '.join(results)}")
    found = results[task](rows, generations, mode, think_end_ids, texts, render)
    header = report_header(task, model_id, dataset, mode, sampling_config)
    write_report(found, header, path, overwrite)
    written = found.sparkSession.read.schema(found.schema).json(f"{path}/results")
    return written.agg(
        F.count("*").alias("n_rows"),
        F.count("parsed_answer").alias("n_parsed"),
        F.count_if(F.col("parsed_answer") == F.col("expected_answer")).alias("n_right"),
    )
