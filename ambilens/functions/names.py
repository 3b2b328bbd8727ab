"""Model names: family type, archive tag, report name, directory slug."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ambilens.functions.text import as_column

MODEL_TYPES = ("base", "instruct")


def base_name(model: Column | str) -> Column:
    """Last path segment; trailing slashes do not count."""
    trimmed = F.rtrim(as_column(model), F.lit("/"))
    return F.substring_index(trimmed, "/", -1)


def infer_model_type(model: Column | str, requested: str = "auto") -> Column:
    """base or instruct by model family; null when the family is unknown."""
    if requested != "auto":
        return F.lit(requested)
    name = F.lower(base_name(model))
    base, instruct = F.lit("base"), F.lit("instruct")
    return (
        F.when(
            F.contains(name, F.lit("qwen3")),
            F.when(F.contains(name, base), base).otherwise(instruct),
        )
        .when(
            F.contains(name, F.lit("qwen2.5")),
            F.when(F.contains(name, instruct), instruct).otherwise(base),
        )
    )


def resolve_model_type(
    model: Column | str, has_chat_template: Column | bool, requested: str = "auto"
) -> Column:
    """Like :func:`infer_model_type`; unknown families need a chat template."""
    if not isinstance(has_chat_template, Column):
        has_chat_template = F.lit(has_chat_template)
    model = as_column(model)
    error = F.concat(
        F.lit("Cannot tell base from instruct, give the model type: "), model
    )
    return F.coalesce(
        infer_model_type(model, requested),
        F.when(has_chat_template, F.lit("instruct")),
        F.raise_error(error).cast("string"),
    )


def model_tag(model: Column | str) -> Column:
    """File tag of a model's archive."""
    return F.lower(F.replace(base_name(model), F.lit("-"), F.lit("_")))


def report_name(model: Column | str, thinking: bool = False) -> Column:
    name = base_name(model)
    return F.concat(name, F.lit("_thinking")) if thinking else name


def model_slug(model: Column | str) -> Column:
    """Directory name: letters and digits, joined by single underscores."""
    model = as_column(model)
    words = F.regexp_replace(F.lower(base_name(model)), r"[^\p{L}\p{N}]+", "_")
    slug = F.trim(words, F.lit("_"))
    error = F.concat(F.lit("No directory name can be made from model "), model)
    return F.when(slug == "", F.raise_error(error).cast("string")).otherwise(slug)
