"""Quality rules whose cutoffs are certified on labelled documents, per stratum.

Each rule measures a text by a whole number from 0 to STEPS that is larger where the text
looks worse, and rejects from a cutoff on. The documents with a quality label are the
holdout: no rule has anything else learned from them. For a rule in a stratum, cutoffs are
tested from the most lenient to the strictest, in that fixed order, and a cutoff passes
while the exact binomial test rejects "more than the limit of good documents are lost".
False rejections only grow along that order, so the first failure ends it, and all that
passed hold together at the sequence's error; the error is divided by the number of
sequences (rules x strata) and the limit by the number of rules. Among the cutoffs that
passed, labelled bad documents pick the most useful whose rejections are shown, by the
same test, to be mostly bad; a rule that has none stays off. Rules then line up by their
use, each labelled text belongs to the first one that rejects it, and a rule whose own
texts aren't worth their loss is off too. Fewer rules lose no more, so the limit holds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.llm.common import chunks
from ambilens.operators.skew import lookup_join
from ambilens.session import stage

WINDOW = 8
STEPS = 1000
#: Share of a stratum's good documents that all rules together may reject, and the
#: probability that any stratum loses more.
LIMIT, ERROR = 0.05, 0.05
#: Largest share of good documents among the labelled ones that a rule rejects.
MOSTLY = 0.5
#: A share of good documents lost weighs as much as LOSS times that share of bad ones caught.
LOSS = 10

RULES = (
    "few_words", "short_words", "long_words", "symbols", "duplicate_lines",
    "repeated_words", "non_letters", "few_distinct", "capitals",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point behind its first
_NON_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha() and b not in _BLANK)


def _number_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of words which the text holds twice or more.

    ``words`` are the numbered words of all texts, one after the other, ``sizes`` how many
    each has; ``window`` is a power of two. Windows are numbered by doubling: equal runs of
    a text's 2, 4, 8 words get equal numbers, without hashing.

    >>> repeated_words(np.array([5, 6, 7, 5, 6, 5, 6]), np.array([5, 2]), 2)
    array([4, 0])
    """
    if not len(words):
        return np.zeros(len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    number, width = pd.factorize(owner * (words.max() + 1) + words)[0], 1
    while width < window and len(number) > width:
        number = pd.factorize(number[:-width] * len(words) + number[width:])[0]
        width *= 2
    covered = np.zeros(len(words) + 1, np.int64)
    if width == window:
        start = np.flatnonzero(
            (np.bincount(number)[number] > 1) & (owner[: len(number)] == owner[window - 1 :])
        )
        covered[start] += 1
        covered[start + window] -= 1
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=len(sizes))


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and RULES of each text, as two arrays of a row per text."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    counts, extents = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(RULES)), np.int64)
    numbers = []
    for at, text in enumerate(texts):
        words = text.split()
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        lines = [line for line in text.split(b"\n") if line.strip()]
        n, chars = len(words), len(text.translate(None, _INNER + _BLANK))
        symbols, duplicates = _number_of(text, _SYMBOLS), len(lines) - len(set(lines))
        counts[at, :4] = n, chars, symbols, duplicates
        if n:
            distinct = len(set(words))
            extents[at] = (
                STEPS - min(n, STEPS), STEPS - min(50 * chars // n, STEPS), min(20 * chars // n, STEPS),
                STEPS * symbols // chars, STEPS * duplicates // len(lines), 0,
                STEPS * _number_of(text, _NON_LETTERS) // chars, STEPS - STEPS * distinct // n,
                STEPS * _number_of(text, _CAPITALS) // chars,
            )
    sizes = counts[:, 0]
    counts[:, 4] = repeated_words(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), sizes)
    extents[:, RULES.index("repeated_words")] = STEPS * counts[:, 4] // np.maximum(sizes, 1)
    return counts, extents


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum, text_hash``, COUNTS, ``base_failed`` and ``extents`` by rule.

    One row per row of ``docs``, whole texts; a null text is an empty one. The stratum is
    the column's text behind "=", and empty for null. Other columns are ignored.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                counts, extents = measures([t or b"" for t in part.column("text").to_pylist()])
                rules = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(extents) + 1, dtype=np.int32) * len(RULES)),
                    pa.array(extents.astype(np.int16).ravel()),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "stratum", "text_hash")]
                    + [pa.array(column) for column in counts.T] + [rules],
                    ["doc_id", "stratum", "text_hash", *COUNTS, "extents"],
                )

    key = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), key.alias("stratum"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("binary"),
    )
    fields = "doc_id long, stratum string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)
    found = rows.mapInArrow(read, f"{fields}, extents array<short>")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def allowed_errors(n: int, limit: float, error: float) -> int:
    """Most errors among ``n`` that show, at ``error``, a rate of at most ``limit``; -1 if none do.

    The largest k with P(Binomial(n, limit) <= k) <= error. Terms more than 12 standard
    deviations below the mean add less than 1e-30 and are left out.

    >>> [allowed_errors(n, 0.05, 0.05) for n in (58, 59, 92, 93)]
    [-1, 0, 0, 1]
    """
    mean = n * limit
    first = max(0, math.floor(mean - 12 * math.sqrt(mean)))
    k = np.arange(first, math.ceil(mean) + 1)
    start = (
        math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1)
        + first * math.log(limit) + (n - first) * math.log1p(-limit)
    )
    steps = np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(limit) - math.log1p(-limit)
    below = np.cumsum(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)])))
    return first + int(np.searchsorted(below, error, "right")) - 1


def choose(extent: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, error: float) -> tuple[int, float]:
    """Cutoff and its use, from counts by extent.

    STEPS + 1 rejects nothing. Cutoff 0 would reject everything and is no choice. Use is
    the share of bad documents caught less LOSS times that of good ones lost; equal use
    goes to the more lenient cutoff.
    """
    lost, caught = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    np.add.at(lost, extent, good)
    np.add.at(caught, extent, bad)
    lost, caught = np.cumsum(lost[::-1])[::-1], np.cumsum(caught[::-1])[::-1]
    spare = allowed_errors(int(lost[0]), limit, error)
    if spare < 0 or not caught[0]:
        return STEPS + 1, 0.0
    passed = np.flatnonzero(lost[1:] <= spare) + 1
    use = caught[passed] * lost[0] - LOSS * lost[passed] * caught[0]
    order = np.lexsort((-passed, -use))
    for best, worth in zip(passed[order], use[order]):
        if worth <= 0:
            break
        if mostly_bad(lost[best], caught[best], error):
            return int(best), float(worth)
    return STEPS + 1, 0.0


def mostly_bad(good: int, bad: int, error: float) -> bool:
    return good <= allowed_errors(int(good + bad), MOSTLY, error)


def learn_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """``stratum, cutoffs``: an array by rule; strata without a labelled document are absent.

    ``labels`` has ``doc_id, quality``; 1 is good. A document with several labels is good
    if one says so, and a text counts once per stratum however often it's repeated, since
    copies tell nothing new. Labels that are null or belong to no document are left out.
    Documents that fail the base rules take no part: they go whatever the cutoffs are.
    What reaches one task is a stratum's histogram, of (STEPS + 1) rows a rule at most.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    )
    rows = measured.where("not base_failed and doc_id is not null").select("doc_id", "stratum", "text_hash", "extents")
    texts = stage(
        rows.distinct().join(known, "doc_id").groupBy("stratum", "text_hash")
        .agg(F.max("good").alias("good"), F.first("extents").alias("extents")),
        "quality-holdout",
    )
    counted = (F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    by_rule = texts.select("stratum", "good", F.posexplode("extents").alias("rule", "extent"))
    histogram = stage(by_rule.groupBy("stratum", "rule", "extent").agg(*counted), "quality-histogram")
    strata = max(1, histogram.select("stratum").distinct().count())
    each, share = error / (strata * len(RULES)), limit / len(RULES)

    def certify(group: pd.DataFrame) -> pd.DataFrame:
        columns = (group[c].to_numpy(np.int64) for c in ("extent", "good", "bad"))
        cutoff, use = choose(*columns, share, each)
        return group[["stratum", "rule"]].head(1).assign(cutoff=cutoff, use=use)

    chosen = histogram.groupBy("stratum", "rule").applyInPandas(certify, "stratum string, rule int, cutoff int, use double")
    line = F.sort_array(F.collect_list(F.struct((-F.col("use")).alias("use"), "rule", "cutoff")))
    lines = stage(chosen.groupBy("stratum").agg(line.alias("line")), "quality-rules")
    rejecting = F.filter("line", lambda r: F.element_at("extents", r["rule"] + 1) >= r["cutoff"])
    own = (
        lookup_join(texts, lines, ["stratum"], "inner", ["text_hash"])
        .groupBy("stratum", F.get(rejecting, F.lit(0))["rule"].alias("rule")).agg(*counted)
    )

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = int(group["good"].sum()), int(group["bad"].sum())
        worth = [
            mostly_bad(r.good, r.bad, each) and r.bad * good > LOSS * r.good * bad for r in group.itertuples()
        ]
        on = group["rule"][np.array(worth) & group["rule"].notna()].astype(int).tolist()
        return pd.DataFrame({"stratum": group["stratum"].head(1), "on": [on]})

    useful = own.groupBy("stratum").applyInPandas(settle, "stratum string, on array<int>")  # a row per rule
    by_number = F.array_sort("line", lambda a, b: a["rule"] - b["rule"])
    return lines.join(useful, "stratum").select("stratum", F.transform(
        by_number, lambda r: F.when(F.array_contains("on", r["rule"]), r["cutoff"]).otherwise(STEPS + 1)
    ).alias("cutoffs"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``failed_rules`` and ``kept``; strata without cutoffs lose nothing more."""
    names = F.array(*map(F.lit, RULES))
    off = F.array_repeat(F.lit(STEPS + 1), len(RULES))
    joined = lookup_join(measured, cutoffs, ["stratum"], spread=["doc_id", "text_hash"])
    ruled = F.arrays_zip(
        F.col("extents").alias("extent"), F.coalesce("cutoffs", off).alias("cutoff"), names.alias("name")
    )
    failed = F.transform(F.filter(ruled, lambda r: r["extent"] >= r["cutoff"]), lambda r: r["name"])
    return joined.withColumn("failed_rules", F.array_join(failed, ",")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == "")
    )


def judge_documents(
    docs: DataFrame, labels: DataFrame, stratum: str | Column = "lang", limit: float = LIMIT, error: float = ERROR
) -> DataFrame:
    """Measures and verdict of every row of ``docs``: :func:`measure`, then :func:`judge`.

    With probability 1 - ``error``, no stratum loses more than ``limit`` of its good
    documents to the cutoffs. Null and empty texts have no word and fail the base rules;
    rows without doc_id have no label and are judged like others; repeated rows come out
    repeated. Without labels no rule is on. An empty table gives an empty one.
    """
    measured = stage(measure(docs, stratum), "quality-measures")
    return judge(measured, learn_cutoffs(measured, labels, limit, error))
