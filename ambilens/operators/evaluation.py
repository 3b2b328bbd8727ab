"""Ambiguity evaluation: from generations to per-row results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.functions.prompts import (
    COMPARISON_CHOICES,
    IDENTIFICATION_CHOICES,
    arranged_orders,
    comparison_prompt,
    expected_answer,
    identification_prompt,
)
from ambilens.functions.text import parse_answer, strip
from ambilens.functions.tokens import choice_probabilities, decision_position
from ambilens.operators.checks import InvalidInput, assert_same_keys, duplicate_keys

PREDICTION_FIELDS = (
    "input_text", "response", "parsed_answer", "decision_token_position",
    "choice_probability",
)


def identification_requests(corpus: DataFrame, style: str = "default") -> DataFrame:
    """Corpus rows with their prompts; ``index`` is the request id."""
    return corpus.withColumn("prompt", identification_prompt("src", style))


def comparison_requests(pairs: DataFrame, style: str = "default") -> DataFrame:
    """Both orders of every pair, with prompts; a request is (pair_index, order)."""
    arranged = pairs.select(
        "pair_index", "ambiguous", "unambiguous",
        F.inline(arranged_orders("ambiguous", "unambiguous")),
    )
    return arranged.withColumn("prompt", comparison_prompt("sentence_1", "sentence_2", style))


def process_generations(
    generations: DataFrame,
    mode: str,
    choices: Sequence[str],
    think_end_ids: Sequence[int] = (),
    texts: Column | None = None,
) -> DataFrame:
    """Add answer, decision position and choice probabilities to generations.

    ``generations`` has ``text``, ``token_ids`` and ``logprobs``; the token-level
    payload is dropped from the result. Token texts come from ``texts``, or from a
    column ``spelled`` (see :func:`ambilens.operators.vocabulary.spell_generations`).
    """
    spelled = "spelled" if "spelled" in generations.columns else None
    position = decision_position(
        "token_ids", "logprobs", mode, choices, think_end_ids, texts, spelled
    )
    placed = generations.withColumn("decision_token_position", position)
    return (
        placed.withColumn("response", strip("text"))
        .withColumn("parsed_answer", parse_answer("response", choices))
        .withColumn(
            "choice_probability",
            choice_probabilities("logprobs", "decision_token_position", choices, texts),
        )
        .drop("text", "token_ids", "logprobs", "spelled")
    )


def join_outputs(requests: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Match outputs to requests by request id; each request has exactly one output.

    Missing, repeated and surplus outputs stop the job. Only keys are compared, so the
    payload moves once, in the join.
    """
    assert_same_keys(requests, outputs, on)
    twice = duplicate_keys(requests, list(on)).limit(1).collect()
    if twice:
        raise InvalidInput(f"Repeated request {twice[0].asDict()}")
    return requests.join(outputs, list(on))


def identification_results(
    corpus: DataFrame,
    generations: DataFrame,
    mode: str = "default",
    think_end_ids: Sequence[int] = (),
    texts: Column | None = None,
    render=None,
) -> DataFrame:
    """Per-sentence report rows; both inputs are keyed by ``index``."""
    style = "cot" if mode == "cot" else "default"
    requests = identification_requests(corpus, style)
    matched = join_outputs(requests, generations, ["index"])
    processed = process_generations(
        matched, mode, IDENTIFICATION_CHOICES, think_end_ids, texts
    )
    prompt = F.col("prompt")
    return processed.select(
        "index",
        F.col("src").alias("sentence"),
        F.col("ambiguity").alias("label"),
        expected_answer("ambiguity").alias("expected_answer"),
        (render(prompt) if render else prompt).alias("input_text"),
        *PREDICTION_FIELDS[1:],
    )


def comparison_results(
    pairs: DataFrame,
    generations: DataFrame,
    mode: str = "default",
    think_end_ids: Sequence[int] = (),
    texts: Column | None = None,
    render=None,
) -> DataFrame:
    """Per-order report rows; generations are keyed by ``pair_index, order``."""
    style = "cot" if mode == "cot" else "default"
    requests = comparison_requests(pairs, style)
    matched = join_outputs(requests, generations, ["pair_index", "order"])
    processed = process_generations(matched, mode, COMPARISON_CHOICES, think_end_ids, texts)
    prompt = F.col("prompt")
    return processed.select(
        "pair_index", "order",
        F.col("ambiguous").alias("ambiguous_sentence"),
        F.col("unambiguous").alias("unambiguous_sentence"),
        "sentence_1", "sentence_2", "expected_answer",
        (render(prompt) if render else prompt).alias("input_text"),
        *PREDICTION_FIELDS[1:],
    )
