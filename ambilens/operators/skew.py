"""Joins against small or unique sides without hot tasks.

``lookup_join`` broadcasts the lookup side only after measuring it. A side beyond
the bound is joined by shuffle with the fact rows of each key spread over salts,
so a key that holds much of the facts never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32

_SALT = "__salt"


def row_bytes(df: DataFrame) -> Column:
    """Approximate width of a row: text length plus a constant per column."""
    width: Column = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.AtomicType) and not isinstance(
            field.dataType, (T.StringType, T.BinaryType)
        ):
            continue
        text = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            text = F.to_json(F.struct(text))
        width = width + F.coalesce(F.octet_length(text), F.lit(0))
    return width.cast("long")


def fits_broadcast(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure ``df``: one aggregate over at most ``max_rows + 1`` rows."""
    probe = df.select(row_bytes(df).alias("b")).limit(max_rows + 1)
    rows, size = probe.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def salt_of(columns: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in columns]), F.lit(salts))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    salts: int = SALTS,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    condition: Column | None = None,
    known_rows: int | None = None,
) -> DataFrame:
    """Join facts to a lookup table; ``how`` is ``left`` or ``inner``.

    ``spread`` names fact columns that tell the rows of one key apart.
    ``condition`` adds a residual over both sides. ``known_rows`` is the size of a
    narrow lookup table that is known without measuring it.
    """
    keys = list(on)
    if known_rows is None:
        small = fits_broadcast(lookup, max_rows, max_bytes)
    else:
        small = known_rows <= max_rows
    if small:
        return _join(facts, F.broadcast(lookup), keys, how, condition)
    spread = list(spread or [name for name in facts.columns if name not in keys])
    facts = facts.withColumn(_SALT, salt_of(spread, salts).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    lookup = lookup.withColumn(_SALT, copies)
    return _join(facts, lookup, [*keys, _SALT], how, condition).drop(_SALT)


def _join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str,
    condition: Column | None,
) -> DataFrame:
    if condition is None:
        return facts.join(lookup, list(keys), how)
    renamed = {name: f"__r_{name}" for name in keys}
    right = lookup.withColumnsRenamed(renamed)
    matches = condition
    for name, other in renamed.items():
        matches = (F.col(f"`{name}`") == F.col(f"`{other}`")) & matches
    return facts.join(right, matches, how).drop(*renamed.values())
