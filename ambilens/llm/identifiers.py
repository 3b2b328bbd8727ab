"""Secret scans: Markov models of random strings and ordinary identifiers.

Two first-order character models are trained from labelled samples of the corpus: values
that the base patterns mark as secrets, and all other identifiers. A stretch of a run of
identifier characters is a secret if its log-likelihood ratio favours the random model by
enough. The corpus is read twice: for transition counts, and, with the models (2 x 69 x 69
numbers), to score every run of LEAST characters and more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambilens.llm.common import CHUNK_CHARS, chunks

KINDS = ("assign", "access", "hex", "markov")

# The base patterns. Letters of the names in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in NAMES)
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of 24 characters and more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Characters of a run to score, less what base spans cover.
LEAST = 8
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
EDGE = 0  # anything else
STATES = len(SYMBOLS) + 1
CELLS = STATES * STATES
#: Natural-log ratio that a stretch must reach, and the logarithm of the run's length over
#: LEAST besides, as a longer run has more stretches.
THRESHOLD = 12.0
SMOOTHING = 1.0

_STATE_OF = np.zeros(128, np.uint8)
for _i, _c in enumerate(SYMBOLS):
    _STATE_OF[ord(_c)] = _i + 1

def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base patterns, in order."""
    found = [
        (m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST
    ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def states(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _STATE_OF[np.minimum(points, 127)], EDGE)


def transitions(state: np.ndarray) -> np.ndarray:
    """Counts of (state, next state), in blocks, as texts may be very long."""
    counts = np.zeros(CELLS, np.int64)
    for at in range(0, len(state) - 1, CHUNK_CHARS):
        part = state[at : at + CHUNK_CHARS + 1].astype(np.int64)
        counts += np.bincount(part[:-1] * STATES + part[1:], minlength=CELLS)
    return counts


def count(docs: DataFrame) -> DataFrame:
    """``cell, n``: transition counts; random ones from CELLS on, ordinary ones below."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts[:CELLS] += transitions(states("\n".join(texts)))
                for text in texts:
                    done = 0
                    for value, end in sorted((value, end) for _, _, end, value in base_spans(text)):
                        # Spans of several kinds may overlap; each character counts once.
                        if end > done:
                            labelled = transitions(states(text[max(value, done) : end]))
                            counts[CELLS:] += labelled
                            counts[:CELLS] -= labelled
                            done = end
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])

    return docs.select("text").mapInArrow(read, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary."""
    table = np.maximum(counts.reshape(2, STATES, STATES), 0) + SMOOTHING
    logs = np.log(table / table.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def score(value: str, ratio: np.ndarray) -> float:
    state = states(value).astype(np.int64)
    return float(ratio[state[:-1], state[1:]].sum())


def stretches(gain: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Stretches of greatest sum that reach ``limit``, in one pass; ends exclusive.

    One ends at its peak, once the sum has fallen by ``limit`` from there or to nothing.
    """
    total = peak = 0.0
    begin = end = 0
    for i, x in enumerate(gain.tolist()):
        if total <= 0:
            total = peak = 0.0
            begin = i
        total += x
        if total > peak:
            peak, end = total, i + 1
        elif peak >= limit and (total <= 0 or total <= peak - limit):
            yield begin, end
            total = peak = 0.0
    if peak >= limit:
        yield begin, end


def _whole(text: str, begin: int, end: int, first: int, last: int) -> tuple[int, int]:
    """A stretch as whole parts of letters and digits, without marks around them.

    A part at its edge of which it covers half or less goes, if there are others.
    """
    wide_begin, wide_end = begin, end
    while wide_begin > first and text[begin].isalnum() and text[wide_begin - 1].isalnum():
        wide_begin -= 1
    while wide_end < last and text[end - 1].isalnum() and text[wide_end].isalnum():
        wide_end += 1
    marks = [i for i in range(begin, end) if not text[i].isalnum()]
    if marks and 2 * (marks[0] - begin) <= marks[0] - wide_begin:
        wide_begin = marks[0]
    if marks and 2 * (end - marks[-1] - 1) <= wide_end - marks[-1] - 1:
        wide_end = marks[-1] + 1
    begin, end = wide_begin, wide_end
    while begin < end and text[begin] in "._-/=":
        begin += 1
    while begin < end and text[end - 1] in "._-/":
        end -= 1
    return begin, end


def random_spans(text: str, base: list[tuple[int, int]], ratio: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spans of the random model in the runs of ``text``, outside the base spans."""
    state = states(text)
    inside = np.zeros(len(state) + 2, np.int8)
    inside[1:-1] = state != EDGE
    for begin, end in base:
        inside[begin + 1 : end + 1] = 0
    step = np.diff(inside)
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - begins >= LEAST
    begins, ends = begins[long], ends[long]
    limits = threshold + np.log((ends - begins) / LEAST)
    found: list[tuple[int, int]] = []
    # In blocks, as texts may be very long.
    cuts = np.append(np.flatnonzero(np.diff(begins // CHUNK_CHARS, prepend=-1)), len(begins))
    for a, b in zip(cuts[:-1], cuts[1:]):
        low = int(begins[a])
        part = state[low : ends[b - 1]].astype(np.int64)
        gain = ratio[part[:-1], part[1:]]
        upto = np.concatenate([[0.0], np.cumsum(np.maximum(gain, 0))])
        # No stretch has more than the sum of a run's positive parts.
        may = upto[ends[a:b] - low - 1] - upto[begins[a:b] - low] >= limits[a:b] - 1e-6
        for i in a + np.flatnonzero(may):
            first, last = int(begins[i]), int(ends[i])
            for lo, hi in stretches(gain[first - low : last - low - 1], float(limits[i])):
                begin, end = _whole(text, first + lo, first + hi + 1, first, last)
                if found and begin < found[-1][1]:
                    found[-1] = (found[-1][0], max(end, found[-1][1]))
                elif any(c.isalpha() for c in text[begin:end]):  # else a number or marks
                    found.append((begin, end))
    return found


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans`` of every row: array of ``kind, start, end``, by start and then KINDS.

    Places are code points, ends exclusive. Base spans always stay; kind ``markov`` marks
    stretches of runs of LEAST and more identifier characters whose ratio reaches
    ``threshold``, widened to whole parts of letters and digits. Null and empty texts have
    no spans, null ids stay null, repeated rows stay repeated, other columns are ignored.
    Without base spans there is no sample of random strings, and nothing is added.
    ``docs`` is read twice.
    """
    counts = np.zeros(2 * CELLS, np.int64)
    for row in count(docs).collect():  # at most 2 * CELLS rows
        counts[row.cell] = row.n
    ratio = ratios(counts)
    known = bool(counts[CELLS:].any())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(text) for text in texts]
                spans = [[(s, k, e) for s, k, e, _ in own] for own in base]
                if known:
                    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
                    marked = [(int(f) + s, int(f) + e) for f, own in zip(first, base) for s, _, e, _ in own]
                    for begin, end in random_spans("\n".join(texts), marked, ratio, threshold):
                        at = int(np.searchsorted(first, begin, "right")) - 1
                        spans[at].append((begin - int(first[at]), 3, end - int(first[at])))
                out = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own)] for own in spans]
                ids = part.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        judge, "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
    )
