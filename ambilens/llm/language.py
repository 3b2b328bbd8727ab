"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) come from all labelled rows, each task emitting the sum of
what it read. The log-probability matrix has BUCKETS x languages entries and is
broadcast; its size is bounded by ``MAX_LANGS``. Scoring adds up matrix rows at the
n-grams of a document, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.llm.common import CHUNK_CHARS, chunks
from ambilens.session import stage

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGS = 256
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """Lower-case code point of every letter; 0 for what isn't a letter.

    Letters whose lower case is more than one code point stay as they are.
    """
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def blocks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, their text's number and letters per text, for blocks of about ``limit`` characters.

    What is counted doesn't depend on ``limit``: a longer text is read in slices that
    take the symbols before them along.
    """
    begin = 0
    while begin < len(texts):
        if len(texts[begin]) > limit:
            for buckets, found in slices(texts[begin], limit):
                letters_found = np.zeros(len(texts), np.int64)
                letters_found[begin] = found
                yield buckets, np.full(len(buckets), begin), letters_found
            begin += 1
            continue
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        buckets, owner, found = grams(texts[begin:end])
        yield buckets, owner + begin, np.bincount(np.arange(begin, end), found, len(texts)).astype(np.int64)
        begin = end


def slices(text: str, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the n-grams of a text, and letters, slice by slice: those that end in it."""
    before, after_letter = np.zeros(0, np.uint32), False
    edge = np.zeros(1, np.uint32)
    for begin in range(0, len(text), limit):
        low = letters()[np.frombuffer(text[begin : begin + limit].encode("utf-32-le", "surrogatepass"), np.uint32)]
        is_letter = low > 0
        keep = is_letter | np.concatenate([[after_letter], is_letter[:-1]])
        after_letter = bool(is_letter[-1])
        first, last = begin == 0, begin + limit >= len(text)
        symbols = np.concatenate([before, edge[: int(first)], low[keep], edge[: int(last)]])
        found = []
        for order, buckets in hashed(symbols):
            start = max(0, len(before) - order + 1)
            if order == 1:  # the edges themselves are no n-gram
                found.append(buckets[start + first : len(buckets) - last])
            else:
                found.append(buckets[start:])
        yield np.concatenate(found) if found else np.zeros(0, np.uint32), int(is_letter.sum())
        before = symbols[-max(ORDERS) + 1 :]


def hashed(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per order, the bucket of the n-gram that begins at each symbol."""
    rolling = np.zeros(len(symbols), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(symbols) - order + 1
        if n <= 0:
            return
        rolling = (rolling[:n] + symbols[order - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        rolling ^= rolling >> np.uint32(15)
        if order in ORDERS:
            yield order, (rolling * np.uint32(0x85EBCA6B) + np.uint32(order)) >> np.uint32(16)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts``, the text of each, and the texts' letter counts.

    Runs of other characters count as one space, and each text begins and ends with one.
    N-grams do not span texts; single spaces are no n-gram.
    """
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)  # with the separator before
    owner = np.append(owner, len(texts) - 1)
    low = letters()[points]
    is_letter = low > 0
    edge = np.zeros(len(points), bool)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    edge[starts] = True
    keep = is_letter | edge
    keep[1:] |= is_letter[:-1]
    low, owner, edge = low[keep], owner[keep], edge[keep]
    found = np.bincount(owner[low > 0], minlength=len(texts))
    all_hashes, all_owners = [], []
    # A separator ends one text and begins the next; an n-gram stays in one text.
    begins = np.cumsum(edge)
    ends = begins - edge
    for order, buckets in hashed(low):
        inside = ends[order - 1 :] == begins[: len(buckets)]
        all_hashes.append(buckets[inside])
        all_owners.append(owner[: len(buckets)][inside])
    return np.concatenate(all_hashes), np.concatenate(all_owners), found


def train_counts(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows with a lang and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch):
                langs = np.array(part.column("lang").to_pylist(), object)
                names, which = np.unique(langs.astype(str), return_inverse=True)
                for buckets, owner, _ in blocks(part.column("text").to_pylist()):
                    both = np.bincount(which[owner] * BUCKETS + buckets, minlength=len(names) * BUCKETS)
                    for name, row in zip(names, both.reshape(-1, BUCKETS)):
                        sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            # A language without a letter is learned as well, with no counts.
            at = at if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(name)] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))],
                ["lang", "bucket", "n"],
            )

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order and the BUCKETS x languages matrix of log-probabilities."""

    def __init__(self, langs: list[str], weights: np.ndarray) -> None:
        self.langs, self.weights = langs, weights

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1 without a letter) and its share among all, 0 to 1.

        The share comes from the mean log-probability per n-gram, so that it tells
        close languages from clear ones in long texts, too.
        """
        sums = np.zeros((len(texts), len(self.langs)))
        n, found = np.zeros((len(texts), 1)), np.zeros(len(texts))
        for buckets, owner, letters_found in blocks(texts):
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(owner, self.weights[buckets, k], len(texts))
            n[:, 0] += np.bincount(owner, minlength=len(texts))
            found += letters_found
        mean = sums / np.maximum(n, 1)
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        top = share[np.arange(len(texts)), best]
        none = found == 0
        return np.where(none, -1, best), np.where(none, 0.0, top)


def train(docs: DataFrame) -> Model:
    """Fit on ``docs`` (text, lang), all languages equally likely beforehand.

    Rows that repeat count as often as they do; columns but text and lang are ignored.
    One packed row of BUCKETS counts per language reaches the driver, MAX_LANGS at most
    (128 MB); more languages are an error. Without labelled rows the model knows none.
    """
    counts = stage(train_counts(docs), "lang-counts")
    langs = sorted(row.lang for row in counts.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"More than {MAX_LANGS} languages")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        row = np.bincount(group["bucket"], group["n"], BUCKETS)
        return pd.DataFrame({"lang": group["lang"][:1], "row": [row.astype("<f8").tobytes()]})

    dense = np.zeros((BUCKETS, len(langs)))
    for row in counts.groupBy("lang").applyInPandas(pack, "lang string, row binary").toLocalIterator():
        dense[:, langs.index(row.lang)] = np.frombuffer(row.row, "<f8")
    dense += SMOOTHING
    return Model(langs, np.log(dense / dense.sum(axis=0)).astype(np.float32))


def predict(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Columns ``keep`` with the language and its score, called ``names``, of each whole text.

    ``und`` and 0 for a text that is null or has no letter, and for all texts if the
    model knows no language. Ties go to the first language by name. One row per row,
    repeated ones included; columns that aren't kept are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * MAX_LANGS floats at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        called = np.array([*known.langs, UNDETERMINED], object)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                if known.langs:
                    best, share = known.score(texts)
                else:
                    best, share = np.full(len(texts), -1), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(called[best], pa.string()), pa.array(share)],
                    [*keep, *names],
                )

    fields = [docs.schema[c] for c in keep]
    schema = type(docs.schema)(fields).add(names[0], "string").add(names[1], "double")
    columns = [*keep] if "text" in keep else [*keep, "text"]
    return docs.select(*columns).mapInArrow(score, schema)


def is_training(bucket: Column) -> Column:
    return F.coalesce(bucket != 1, F.lit(True))
