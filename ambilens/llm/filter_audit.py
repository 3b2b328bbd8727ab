"""How filters interact: what each removes in every order they can be applied in.

A document is a mask: which filters it fails, and how it's labelled. What a mask does at
all steps of all orders is fixed, so it is written once as one wide integer: a field of 64
bits for every outcome (order, step, what happened). A part's documents are the sum of
their masks' integers, each times the number of documents; adding integers adds up all
fields at once, and as a field counts rows it can't reach the next one's bits. The sum is
unpacked at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ambilens.llm.common import chunks
from ambilens.session import stage

FILTERS = "ABCDE"
ORDERS = tuple("".join(order) for order in permutations(FILTERS))
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELD_BYTES = 8
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point behind its first
_SYMBOLS = b"#$%&*|"

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


@cache
def packed(mask: int) -> int:
    """All outcomes of one document with ``mask``: field by field 0 or 1, as one integer."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
    for row, order in zip(fields, ORDERS):
        failing = [bool(mask & bit(letter)) for letter in order]
        first = failing.index(True) if True in failing else len(order)
        for step, fails in enumerate(failing):
            removed = step == first
            row[step] = (step < first, removed, fails and step > first, removed and bool(mask & GOOD), removed and bool(mask & TOXIC))
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed integers: orders x steps x outcomes."""
    size = len(ORDERS) * len(FILTERS) * len(OUTCOMES)
    raw = total.to_bytes(size * FIELD_BYTES, "little")
    return np.frombuffer(raw, "<u8").astype(np.int64).reshape(len(ORDERS), len(FILTERS), len(OUTCOMES))


def audit(counts: dict[int, int]) -> pd.DataFrame:
    """Rows of one part, for its number of documents by mask.

    >>> rows = audit({bit("A") | bit("B"): 3, 0: 2})
    >>> rows.loc[(rows.filter_order == "ABCDE"), ["kept", "removed", "redundant"]].values.tolist()[:2]
    [[2, 3, 0], [2, 0, 3]]
    """
    fields = unpacked(sum(packed(mask) * n for mask, n in counts.items()))
    letters = np.array([list(order) for order in ORDERS])
    rows = pd.DataFrame({
        "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
    })
    for outcome, found in zip(OUTCOMES, fields.reshape(-1, len(OUTCOMES)).T):
        rows[outcome] = found
    shares = {x: int(fields[:, :, OUTCOMES.index("removed")][letters == x].sum()) for x in FILTERS}
    failing = GOOD - 1
    only = {x: sum(n for mask, n in counts.items() if mask & failing == bit(x)) for x in FILTERS}
    rows["shapley"] = [shares[x] for x in letters.ravel()]
    rows["unique_fails"] = [only[x] for x in letters.ravel()]
    return rows


def text_mask(text: bytes) -> int:
    """Filters A to D that a text fails; E needs the other texts."""
    words = text.split()
    points = len(text.translate(None, _INNER))
    return (
        (len(words) < 100) * bit("A")
        + (100 * len(set(words)) < 80 * len(words)) * bit("B")
        + (100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * points) * bit("C")
        + (len(text.translate(None, _SYMBOLS)) < len(text)) * bit("D")
    )


def text_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, text`` (SHA-256 of the text), ``mask`` of filters A to D, by row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                texts = [t or b"" for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("part"),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([text_mask(t) for t in texts], pa.int32()),
                ], ["doc_id", "part", "text", "mask"])

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("binary"),
    )
    return rows.mapInArrow(read, "doc_id long, part string, text binary, mask int")


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n``: documents by all filters they fail and their labels.

    Rows that agree in everything are added up on the map side at each step. Filter E: of
    a text's rows, those with its smallest doc_id pass. A text is a few rows by then, one
    per part and labels, so no text's copies meet in one task.
    """
    known = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .select("doc_id", (F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("toxic", F.lit(0)) * TOXIC).alias("labelled"))
        .where("labelled > 0")
    )
    # Rows without an id have no label, are no copy of others and make no copies.
    nameless = masked.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    named = masked.where("doc_id is not null").groupBy("doc_id", "text", "part", "mask").agg(F.count("*").alias("n"))
    seen = named.join(known, "doc_id", "left").withColumn("mask", F.col("mask") + F.coalesce("labelled", F.lit(0)))
    # An id occurs once in each of these groups, so the rows of the smallest are known.
    groups = seen.groupBy("text", "part", "mask").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    smallest = F.min("first").over(Window.partitionBy("text"))
    passing = F.when(F.col("first") == smallest, F.col("n_first")).otherwise(0)
    split = groups.withColumn("passing", passing).select("part", F.inline(F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")),
        F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )))
    return split.unionByName(nameless).where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What happens at each step of every order of the five filters, by ``part``.

    All rows and whole texts; a null text is an empty one, a null part the empty string.
    Rows that share a doc_id are documents of their own: they pass E together, as neither
    id is smaller. A document is good, or toxic, if one of its labels says so; labels of no
    document and null labels count for nothing. Very long texts take memory for their own
    words. Other columns are ignored; an empty table gives no part and no row.
    """
    masked = stage(text_masks(docs, part), "audit-masks")

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        # Masks are 128 at most, whatever the part holds.
        rows = audit(dict(zip(group["mask"].tolist(), group["n"].tolist())))
        return rows.assign(part=group["part"].iloc[0])[[field.split()[0] for field in AUDIT.split(", ")]]

    return mask_counts(masked, labels).groupBy("part").applyInPandas(add_up, AUDIT)
