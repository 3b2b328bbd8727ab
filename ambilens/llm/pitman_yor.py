"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Each word has a restaurant for what follows it; all of these share the root restaurant,
whose base is uniform over the vocabulary and one unknown word. There are as many
restaurants as words. Their totals are summed by word in a stored table, and each shard
joins those of the restaurants that it has customers or texts to score in.

The corpus is read once. Tasks cut it into chunks and send each token, as (word,
context, document), to the shard of its word. A shard holds every (context, word) pair
of its words and with it the tables where that word is served, in the contexts and in
the root. Words with many tokens are split over shards by context. A shard seats its
customers and resamples all of them in every Gibbs step, given the totals of its
restaurants; rounds pass new totals on. Predictive probabilities are averaged over samples, and sums per
document, not per token, go back to the chunk.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambilens.llm.words import dictionary, hashes, mixed, numbered
from ambilens.session import scratch_path, stage
from ambilens.sinks.tables import delete

TOKENS_PER_SHARD = 2_000_000
#: Totals that one task sums, as (shard, restaurant) pairs.
PAIRS_PER_HOME = 1_000_000
#: Documents and tokens of a chunk; document numbers in a chunk are 16 bits.
CHUNK_DOCS, CHUNK_TOKENS = 1 << 16, 4_000_000
#: A word is split when it may hold more than this share of a shard. Shares come from a
#: sample of SAMPLE_DOCS documents per shard; they decide the layout only.
SPLIT_SHARE = 0.25
SAMPLE_DOCS = 64
ROUNDS, BURN_IN, SAMPLES = 2, 8, 8
FEW, ONE_BY_ONE = 4, 32
#: Up to so many customers, the law of a dish's number of tables is tabulated; beyond, it
#: comes from the saddle point of its generating function, corrected by the last tabulated row.
EXACT = 1024
CHILD_STRENGTH, ROOT_STRENGTH = 1.0, 10.0

_PIECES = (
    "shard int, chunk long, train int, words binary, counts binary, restaurants binary, contexts binary, docs binary, "
    "ids array<long>, tokens binary"
)
_STATE = (
    "shard int, words binary, types binary, restaurants binary, contexts binary, counts binary, tokens binary, "
    "token_chunks binary, token_docs binary, chunks array<long>, chunk long, train int, ids array<long>, n binary"
)


def _packed(values: np.ndarray) -> bytes:
    """Compressed, behind the size without: shuffles of mostly small numbers get a good deal smaller."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), kind)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, for unsigned numbers that rise in runs; ``_summed`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _places(places: np.ndarray, listed: int) -> np.ndarray:
    """Places in a list of so many, in two bytes each where they fit."""
    return places.astype(np.uint16 if listed <= 1 << 16 else np.uint32)


def _read_places(blob: bytes, n: int) -> np.ndarray:
    raw = _unpacked(blob, np.uint8)
    return raw.view(np.uint32 if len(raw) == 4 * n else np.uint16)


@dataclass
class Layout:
    """Shards, and into how many each word with many tokens is split."""

    shards: int
    splits: dict[int, int]

    def shard_of(self, words: np.ndarray, contexts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Shard of each token; ``which`` is its place in ``words``."""
        home = (mixed(words + np.uint64(1)) % np.uint64(self.shards)).astype(np.int32)[which]
        if self.splits:
            parts = np.array([self.splits.get(int(w), 1) for w in words])
            many = np.flatnonzero(parts[which] > 1)
            part = mixed(contexts[many].astype(np.uint64)) >> np.uint64(32)
            part = (part * parts[which[many]].astype(np.uint64)) >> np.uint64(32)
            home[many] = mixed(words[which[many]] + mixed(part)) % np.uint64(self.shards)
        return home


def plan_layout(docs: DataFrame, tokens_per_shard: int = TOKENS_PER_SHARD) -> Layout:
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-(size // 6 + rows) // tokens_per_shard))
    if shards == 1:
        return Layout(1, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = dictionary(), np.zeros(0, np.int64)
        for batch in batches:
            for ids in numbered((t.as_py() for t in batch.column("text")), known):
                sums = np.pad(sums, (0, max(0, len(known) - len(sums))))
                np.add.at(sums, np.append(ids, 0), 1)
        if len(sums):
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes(known).view(np.int64)), pa.array(sums)], ["word", "n"]
            )

    fraction = min(1.0, SAMPLE_DOCS * shards / max(rows, 1))
    counted = stage(
        docs.select("text").sample(fraction, seed=7).mapInArrow(count, "word long, n long")
        .groupBy("word").agg(F.sum("n").alias("n")), "lm-sample",
    )
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = SPLIT_SHARE / shards
    # Shares of more than ``limit``: at most shards / SPLIT_SHARE words.
    often = counted.where(F.col("n") > total * limit).collect() if total else []
    return Layout(shards, {row.word % (1 << 64): 1 + int(row.n / total / limit) for row in often})


def deal(docs: DataFrame, held_out: Column, layout: Layout) -> DataFrame:
    """Chunks dealt to the shards of their words, and a row with each chunk's documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)) // 6 + 1
            begin = 0
            while begin < batch.num_rows:
                reach = np.searchsorted(np.cumsum(lengths[begin:]), CHUNK_TOKENS, "right")
                n = max(1, min(int(reach), CHUNK_DOCS, batch.num_rows - begin))
                yield _chunk(batch.slice(begin, n), (task << 32) | number, layout)
                begin, number = begin + n, number + 1

    rows = docs.select("doc_id", "text", held_out.alias("held"))
    return rows.mapInArrow(cut, _PIECES)


def _chunk(batch: pa.RecordBatch, chunk: int, layout: Layout) -> pa.RecordBatch:
    held = np.asarray(batch.column("held").to_pylist(), bool)
    order = np.argsort(held, kind="stable")  # training documents first
    train = int((~held).sum())
    known = dictionary()
    texts = batch.column("text")
    lists = list(numbered((texts[int(i)].as_py() for i in order), known))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
    ends = np.cumsum(sizes)
    word = np.zeros(ends[-1], np.int32)
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    word[inner] = np.concatenate(lists)
    del lists
    before = np.concatenate([np.zeros(1, np.int32), word[:-1]])  # a text begins after an end
    word_hash = hashes(known)
    doc = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16)
    shard = layout.shard_of(word_hash, word_hash[before], word)
    place = np.argsort(shard.astype(np.int64) << 32 | word, kind="stable")
    shard, word, before, doc = shard[place], word[place], before[place], doc[place]
    first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (word[1:] != word[:-1])]))
    runs = np.diff(np.append(first, len(word))).astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate([[True], shard[first][1:] != shard[first][:-1]]))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(first))):
        lo, hi = first[a], first[b] if b < len(first) else len(word)
        own, context = np.unique(before[lo:hi], return_inverse=True)
        rows.append((
            int(shard[lo]), chunk, train, word_hash[word[first[a:b]]].tobytes(), _packed(runs[a:b]),
            word_hash[own].tobytes(), _packed(_places(context, len(own))), _packed(_steps(doc[lo:hi])), None, None,
        ))
    ids = batch.column("doc_id").take(pa.array(order)).to_pylist()
    rows.append((chunk % layout.shards, chunk, train, None, None, None, None, None, ids, sizes.astype(np.uint32).tobytes()))
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.binary()]
    names = [part.split()[0] for part in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def gather(dealt: DataFrame, shards: int) -> DataFrame:
    """One row per shard with its (word, context) types and their tokens, stored.

    Rows with a chunk's documents pass through.
    """

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = [
            (key[0], *[None] * 9, r.chunk, r.train, r.ids, r.tokens)
            for r in group[group["words"].isna()].itertuples()
        ]
        group = group[group["words"].notna()].sort_values("chunk", kind="stable")
        if len(group):
            out.append(_merged(key[0], group))
        return pd.DataFrame(out, columns=[part.split()[0] for part in _STATE.split(", ")])

    spread = dealt.repartition(shards, "shard") if shards > 1 else dealt
    return stage(spread.groupBy("shard").applyInPandas(merge, _STATE), "lm-state")


def _merged(shard: int, group: pd.DataFrame) -> tuple:
    chunks, inverse = np.unique(group["chunk"].to_numpy(), return_inverse=True)
    words = [np.frombuffer(b, np.uint64) for b in group["words"]]
    all_words, dish = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.concatenate([_unpacked(b, np.uint32) for b in group["counts"]])
    docs = [_summed(_unpacked(b, np.uint16)) for b in group["docs"]]
    sizes, docs = [len(d) for d in docs], np.concatenate(docs)
    lists = [np.frombuffer(b, np.uint64) for b in group["restaurants"]]
    restaurants, at = np.unique(np.concatenate(lists), return_inverse=True)
    ends = np.cumsum([len(r) for r in lists])
    key = np.repeat(dish, counts) << 32 | np.concatenate([
        at[end - len(r) : end][_read_places(b, n)] for r, end, b, n in zip(lists, ends, group["contexts"], sizes)
    ])
    chunk = np.repeat(inverse, sizes).astype(np.uint32)
    train = docs < np.repeat(group["train"].to_numpy(), sizes)
    place = np.argsort(key, kind="stable")
    key = key[place]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tokens = np.diff(np.append(first, len(key)))
    known = np.add.reduceat(train[place].astype(np.int64), first)
    types = np.bincount(key[first] >> 32, minlength=len(all_words))
    return (
        shard, all_words.tobytes(), _packed(types.astype(np.uint32)), restaurants.tobytes(),
        _packed(_steps(_places(key[first] & 0xFFFFFFFF, len(restaurants)))),
        _packed(known.astype(np.uint32)), _packed(tokens.astype(np.uint32)),
        _packed(_places(chunk[place], len(chunks))), _packed(docs[place]), chunks.tolist(), None, None, None, None,
    )


def _opened(row: dict) -> dict:
    """A shard's row with what :class:`Chain` reads as plain numbers."""
    counts = _unpacked(row["counts"], np.uint32)
    contexts = _summed(_read_places(row["contexts"], len(counts)))
    return row | {
        "types": _unpacked(row["types"], np.uint32).tobytes(), "contexts": contexts.tobytes(), "counts": counts.tobytes()
    }


@lru_cache(4)
def _seatings(discount: float, most: int) -> list[np.ndarray]:
    """For c customers, the logarithms of the generalized Stirling numbers S(c, 1..c)."""
    rows = [np.zeros(0), np.zeros(1)]
    for c in range(1, most):
        stay = np.log(c - discount * np.arange(1, c + 1)) + rows[c]
        rows.append(np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, rows[c])))
    return rows


@lru_cache(4)
def _saddles(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(log of customers per table, saddle point) for f(x) = 1 - (1 - x)^discount.

    S(c, t) is c! / (t! discount^t) times the coefficient of x^c in f^t. The saddle point
    is kept as u = log(1 - x).
    """
    u = -np.geomspace(1e-6, 600, 20_000)
    return np.log(-np.expm1(u) * discount * np.exp((discount - 1) * u) / -np.expm1(discount * u)), u


def _saddle_terms(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) by its saddle point, without log(c! / t!)."""
    r = c / t
    u = np.interp(np.log(r), *_saddles(discount))
    x = -np.expm1(u)
    spread = r * np.maximum(1 + x * (1 - discount) * np.exp(-u) - r, 1e-12)
    return t * np.log(-np.expm1(discount * u) / discount) - c * np.log(x) - 0.5 * np.log(t * spread)


@lru_cache(4)
def _correction(discount: float) -> np.ndarray:
    """What the saddle point lacks for t = 0, 1, .. tables; it depends on t alone where t << c."""
    t = np.arange(1, EXACT // 4 + 1)
    lacks = _seatings(discount, EXACT)[EXACT][: len(t)] + np.cumsum(np.log(t)) - _saddle_terms(np.full(len(t), EXACT), t, discount)
    return np.append(0.0, lacks - lacks[-1])


def _draw(log_weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A place in each row."""
    upto = np.cumsum(np.exp(log_weight - log_weight.max(axis=1, keepdims=True)), axis=1)
    return (upto[:, :-1] <= rng.random((len(upto), 1)) * upto[:, -1:]).sum(axis=1)


def _draw_large(c: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """``draw_tables`` for dishes of more than EXACT customers."""
    low, high = np.zeros(len(c)), np.log(c)
    for _ in range(30):  # the peak: the weight's growth per table falls with t
        t = np.exp((low + high) / 2)
        u = np.interp(np.log(c / t), *_saddles(discount))
        rises = opening * -np.expm1(discount * u) > discount * t
        low, high = np.where(rises, np.log(t), low), np.where(rises, high, np.log(t))
    peak = np.exp(low)
    reach = 12 * np.sqrt(peak) + 24  # the law is no wider than Poisson's
    first = np.maximum(1, peak - reach).astype(np.int64)
    width = np.minimum(c, (peak + reach).astype(np.int64)) - first + 1
    tables = np.zeros(len(c), np.int64)
    correction = _correction(discount)
    order, at = np.argsort(width), 0
    while at < len(order):
        n = 1  # dishes of similar widths together
        while at + n < len(order) and width[order[at + n]] <= 1.2 * width[order[at]] and n * width[order[at]] < 1 << 18:
            n += 1
        some = order[at : at + n]
        t = first[some][:, None] + np.arange(width[some[-1]])
        many = np.broadcast_to(c[some][:, None], t.shape)
        inside = t <= many
        t = np.minimum(t, many)
        weight = _saddle_terms(many, t, discount) + t * np.log(opening[some])[:, None] - np.cumsum(np.log(t), axis=1)
        weight += correction[np.where(t < len(correction), t, 0)]
        tables[some] = first[some] + _draw(np.where(inside, weight, -np.inf), rng)
        at += n
    return tables


def draw_tables(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each dish by its law: t tables have weight opening^t S(c, t).

    This reseats every customer of the dish: it is what any number of single moves tends to.
    """
    tables = np.minimum(customers, 1)
    large = np.flatnonzero(customers > EXACT)
    tables[large] = _draw_large(customers[large], opening[large], discount, rng)
    several = np.flatnonzero((customers > 1) & (customers <= EXACT))
    place = several[np.argsort(customers[several], kind="stable")]
    counts, first = np.unique(customers[place], return_index=True)
    rows = _seatings(discount, EXACT)
    for c, lo, hi in zip(counts.tolist(), first, np.append(first[1:], len(place))):
        width = max(1, (1 << 20) // c)
        for at in range(lo, hi, width):
            dishes = place[at : min(at + width, hi)]
            tables[dishes] += _draw(rows[c] + np.log(opening[dishes])[:, None] * np.arange(1, c + 1), rng)
    return tables


class Tables:
    """Tables of many dishes, each with its customers; one empty table always at the end.

    Single moves: the plain form of ``draw_tables``, which the tests compare. Tables of a dish are next to each other. ``move`` takes one customer of each given
    dish away and seats it anew: the Gibbs step of a Pitman-Yor restaurant, for as many
    dishes at a time as there are.
    """

    def __init__(self, dishes: int, discount: float, rng: np.random.Generator) -> None:
        self.n, self.discount, self.rng = dishes, discount, rng
        self.size = np.zeros(dishes, np.int64)
        self.owner = np.arange(dishes)
        self._index()

    def _index(self) -> None:
        self.last = np.flatnonzero(np.append(self.owner[1:] != self.owner[:-1], True)) if self.n else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], self.last[:-1] + 1]) if self.n else self.last

    def tables(self) -> np.ndarray:
        return np.add.reduceat((self.size > 0).astype(np.int64), self.first) if self.n else np.zeros(0, np.int64)

    def _pick(self, weight: np.ndarray, dishes: np.ndarray) -> np.ndarray:
        upto = np.cumsum(weight)
        low = upto[self.first[dishes]] - weight[self.first[dishes]]
        high = upto[self.last[dishes]]
        at = np.searchsorted(upto, low + self.rng.random(len(dishes)) * (high - low), "right")
        return np.clip(at, self.first[dishes], self.last[dishes])

    def remove(self, dishes: np.ndarray) -> None:
        """Take one random customer of each dish away; all must have one."""
        chosen = self._pick(self.size.astype(float), dishes)
        empty = self.size[chosen] == 0  # only by rounding at a border
        chosen[empty] = self.first[dishes[empty]]
        while (bad := self.size[chosen] == 0).any():
            chosen[bad] += 1
        self.size[chosen] -= 1

    def add(self, dishes: np.ndarray, opening: np.ndarray) -> None:
        """Seat one customer of each dish; ``opening`` is the weight of a new table."""
        weight = np.where(self.size > 0, self.size - self.discount, 0.0)
        weight[self.last[dishes]] = opening
        chosen = self._pick(weight, dishes)
        dead = (self.size[chosen] == 0) & (chosen != self.last[dishes])
        chosen[dead] = self.last[dishes[dead]]
        self.size[chosen] += 1
        self._tidy()

    def _sizes(self, dish: int) -> np.ndarray:
        sizes = self.size[self.first[dish] : self.last[dish]]
        return sizes[sizes > 0]

    def _seated(self, sizes: np.ndarray, customers: int, opening: float) -> np.ndarray:
        """Tables of one dish after many more customers, in blocks of a quarter of those seated."""
        while customers:
            block = min(customers, max(1, int(sizes.sum()) // 4))
            weight = np.append(sizes - self.discount, opening)
            drawn = self.rng.multinomial(block, weight / weight.sum())
            sizes = np.concatenate([sizes + drawn[:-1], np.ones(drawn[-1], np.int64)])
            customers -= block
        return sizes

    def _replace(self, dishes: np.ndarray, tables: list[np.ndarray]) -> None:
        drop = np.zeros(self.n, bool)
        drop[dishes] = True
        keep = ~drop[self.owner]
        owner = np.concatenate([self.owner[keep], *[np.full(len(t) + 1, d) for d, t in zip(dishes, tables)]])
        size = np.concatenate([self.size[keep], *[np.append(t, 0) for t in tables]])
        place = np.argsort(owner, kind="stable")
        self.owner, self.size = owner[place], size[place]
        self._index()

    def fill(self, customers: np.ndarray, opening: np.ndarray) -> None:
        """Seat all customers: the first ONE_BY_ONE of each dish singly, then in blocks.

        The few dishes with many customers are filled apart, so that their rounds don't
        pass over the tables of all others.
        """
        many = np.flatnonzero(customers > FEW)
        for k in range(FEW):
            dishes = np.flatnonzero((customers > k) & (customers <= FEW))
            if len(dishes):
                self.add(dishes, opening[dishes])
        if not len(many):
            return
        own, open_ = customers[many], opening[many]
        apart = Tables(len(many), self.discount, self.rng)
        for k in range(min(int(own.max()), ONE_BY_ONE)):
            dishes = np.flatnonzero(own > k)
            apart.add(dishes, open_[dishes])
        large = np.flatnonzero(own > ONE_BY_ONE)
        if len(large):
            apart._replace(large, [
                apart._seated(apart._sizes(d), int(own[d]) - ONE_BY_ONE, float(open_[d])) for d in large
            ])
        drop = np.zeros(self.n, bool)
        drop[many] = True
        keep = ~drop[self.owner]
        owner = np.concatenate([self.owner[keep], many[apart.owner]])
        size = np.concatenate([self.size[keep], apart.size])
        place = np.argsort(owner, kind="stable")
        self.owner, self.size = owner[place], size[place]
        self._index()

    def _tidy(self) -> None:
        """Drop empty tables but the last of each dish, and give taken ones a new last."""
        keep = self.size > 0
        keep[self.last] = True
        taken = np.zeros(len(self.size), bool)
        taken[self.last[self.size[self.last] > 0]] = True
        copies = np.where(keep, 1 + taken, 0)
        self.owner = np.repeat(self.owner, copies)
        size = np.repeat(self.size, copies)
        ends = np.cumsum(copies)[taken] - 1
        size[ends] = 0
        self.size = size
        self._index()

    def move(self, dishes: np.ndarray, opening: np.ndarray) -> None:
        if len(dishes):
            self.remove(dishes)
            self.add(dishes, opening)


@dataclass
class Totals:
    """What all shards share: numbers and parts of split words; and a shard's restaurants."""

    customers: np.ndarray  # of each restaurant of the shard
    tables: np.ndarray
    tokens: int
    vocabulary: int
    root_customers: int
    root_tables: int
    discount: float
    root_discount: float
    split: dict[int, tuple[int, int, int]]  # word -> training tokens, root customers, root tables


class Chain:
    """Seating of one shard; restaurants' totals stay as the last round left them."""

    def __init__(self, row: dict, totals: Totals) -> None:
        self.totals = totals
        self.words = np.frombuffer(row["words"], np.uint64)
        per_word = np.frombuffer(row["types"], np.uint32)
        self.dish = np.repeat(np.arange(len(self.words)), per_word)
        wide = len(row["contexts"]) == 4 * len(self.dish)
        self.context = np.frombuffer(row["contexts"], np.uint32 if wide else np.uint16)
        self.count = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.rng = np.random.default_rng(row["shard"])
        self.known = np.bincount(self.dish, self.count, len(self.words)).astype(np.int64)
        self.open = np.flatnonzero(self.count > 1)
        self.t = (self.count > 0).astype(np.int64)
        # Words of other shards' parts, for split words.
        rest = [totals.split.get(int(w)) for w in self.words] if totals.split else []
        self.others = np.zeros((2, len(self.words)), np.int64)
        self.share = [(i, r) for i, r in enumerate(rest) if r]
        self.root_c = np.bincount(self.dish, self.t, len(self.words)).astype(np.int64)
        self.root_t = (self.root_c > 0).astype(np.int64)
        self.base = 1 / (totals.vocabulary + 1)

    def root(self) -> np.ndarray:
        """P(word) of the root, for the words of the shard."""
        t = self.totals
        c, tables = self.root_c + self.others[0], self.root_t + self.others[1]
        if not t.root_customers:
            return np.full(len(self.words), self.base)
        opening = (ROOT_STRENGTH + t.root_discount * t.root_tables) * self.base
        return (np.maximum(c - t.root_discount * tables, 0) + opening) / (ROOT_STRENGTH + t.root_customers)

    def run(self, burn_in: int, samples: int) -> Iterator[None]:
        """Seat and resample; yields at each sample."""
        t = self.totals
        for i, (_, c, tables) in self.share:
            # What the word's other parts had, in proportion, less this part.
            self.others[:, i] = max(0, c - self.root_c[i]), max(0, tables - self.root_t[i])
        strength = CHILD_STRENGTH + t.discount * t.tables[self.context]
        opening = (ROOT_STRENGTH + t.root_discount * t.root_tables) * self.base
        several = np.flatnonzero(self.known > 1)
        every = np.full(len(several), opening)
        for step in range(burn_in + samples):
            weight = strength[self.open] * self.root()[self.dish[self.open]]
            self.t[self.open] = draw_tables(self.count[self.open], weight, t.discount, self.rng)
            self.root_c = np.bincount(self.dish, self.t, len(self.words)).astype(np.int64)
            self.root_t[several] = draw_tables(self.root_c[several], every, t.root_discount, self.rng)
            if step >= burn_in:
                yield

    def probability(self) -> np.ndarray:
        """P(word | context) of each type in the current seating."""
        t = self.totals
        c_u, t_u = t.customers[self.context], t.tables[self.context]
        own = np.maximum(self.count - t.discount * self.t, 0)
        back = np.where(c_u > 0, CHILD_STRENGTH + t.discount * t_u, CHILD_STRENGTH)
        return (own + back * self.root()[self.dish]) / (CHILD_STRENGTH + c_u)


_SUMS = "shard int, home int, restaurants binary, customers binary, tables binary, kind int, key long, a long, b long, c long"
_LIGHT = ["shard", "words", "types", "restaurants", "contexts", "counts"]


def _homes(restaurants: np.ndarray, homes: int) -> np.ndarray:
    """The task that sums a restaurant's totals."""
    return (mixed(restaurants + np.uint64(2)) % np.uint64(homes)).astype(np.int64)


def _own_totals(row: dict, totals: Totals, homes: int) -> Totals:
    """Totals with those of the shard's restaurants, which come by home."""
    place = np.argsort(_homes(np.frombuffer(row["restaurants"], np.uint64), homes), kind="stable")
    own = np.zeros((2, len(place)), np.int64)
    for k, name in enumerate(("customers", "tables")):
        own[k][place] = np.concatenate([_unpacked(b, np.int64) for b in row[name]])
    return replace(totals, customers=own[0], tables=own[1])


def _sums(
    state: DataFrame, totals: Totals | None, splits: frozenset[int], homes: int, place: str | None = None
) -> tuple[DataFrame, dict[int, dict[int, tuple[int, int, int]]]]:
    """Totals over shards: of restaurants, as a stored table by shard and home; and split
    words and plain numbers, at most one row per split word, at the driver.

    ``state`` holds the restaurants' totals of the round before where ``totals`` is given.
    ``place`` is where the table is stored, if given.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                chain = Chain(_opened(row), _own_totals(row, totals, homes) if totals else _nothing())
                if totals:
                    for _ in chain.run(BURN_IN, 1):
                        pass
                restaurants = np.frombuffer(row["restaurants"], np.uint64)
                sums = [
                    np.bincount(chain.context, n, len(restaurants)).astype(np.uint32) for n in (chain.count, chain.t)
                ]
                home = _homes(restaurants, homes)
                order = np.argsort(home, kind="stable")
                cuts = np.searchsorted(home[order], np.arange(homes + 1))
                sent = [
                    (row["shard"], h, restaurants[order[lo:hi]].tobytes(), *[_packed(x[order[lo:hi]]) for x in sums])
                    for h, lo, hi in zip(range(homes), cuts[:-1], cuts[1:]) if hi > lo
                ]
                yield pd.DataFrame(sent, columns=names[:5]).reindex(columns=names)
                used = chain.count > 0
                split = np.fromiter((int(w) in splits for w in chain.words), bool, len(chain.words))
                whole = ~split & (chain.known > 0)
                c = chain.root_c
                rows = [
                    pd.DataFrame({"kind": 1, "key": chain.words[split].view(np.int64), "a": chain.known[split],
                                  "b": c[split], "c": chain.root_t[split]}),
                    pd.DataFrame({"kind": 2, "key": range(4), "c": 0, "a": [
                        int(whole.sum()), int(c[whole].sum()), int((chain.count[used] == 1).sum()), int((c[whole] == 1).sum())],
                        "b": [int(chain.known.sum()), int(chain.root_t[whole].sum()), int((chain.count == 2).sum()), int((c[whole] == 2).sum())]}),
                ]
                yield pd.concat(rows).reindex(columns=names)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(b) // 8 for b in group["restaurants"]]
        ends = np.cumsum(sizes)
        found, at = np.unique(np.frombuffer(b"".join(group["restaurants"]), np.uint64), return_inverse=True)
        sums = [
            np.bincount(at, np.concatenate([_unpacked(b, np.uint32) for b in group[name]]), len(found)).astype(np.int64)[at]
            for name in ("customers", "tables")
        ]
        return pd.DataFrame({
            "shard": group["shard"], "home": group["home"],
            **{name: [_packed(x[e - n : e]) for e, n in zip(ends, sizes)] for name, x in zip(("customers", "tables"), sums)},
        })

    names = [part.split()[0] for part in _SUMS.split(", ")]
    columns = [*_LIGHT, *(["customers", "tables"] if totals else [])]
    added = state.select(*columns).mapInPandas(add_up, _SUMS)
    spark = added.sparkSession
    raw = scratch_path(spark, "lm-sums")
    sent = stage(added, path=raw)
    summed = (
        sent.where("kind is not null")
        .groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    )
    found: dict[int, dict[int, tuple[int, int, int]]] = {1: {}, 2: {}}
    for row in summed.collect():
        found[row.kind][row.key] = (row.a, row.b, row.c)
    parts = sent.where("home is not null").select("shard", "home", "restaurants", "customers", "tables")
    spread = parts.repartition(homes, "home") if homes > 1 else parts
    merged = spread.groupBy("home").applyInPandas(merge, "shard int, home int, customers binary, tables binary")
    merged = stage(merged, "lm-totals", place)
    delete(spark, raw)
    return merged, found


def _drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete shuffle files of tables that were stored and are no longer used.

    Its cleaner follows the driver's garbage collection, which alone may not come for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _joined(state: DataFrame, merged: DataFrame) -> DataFrame:
    """Shards with the totals of their restaurants: one blob per home, by home."""
    by_home = F.array_sort(F.collect_list(F.struct("home", "customers", "tables")))
    own = merged.groupBy("shard").agg(by_home.alias("own"))
    return state.join(own.select("shard", "own.customers", "own.tables"), "shard")


def _nothing() -> Totals:
    zero = np.zeros(0, np.int64)
    return Totals(zero, zero, 0, 0, 0, 0, 0.5, 0.5, {})


def _totals(found: dict[int, dict[int, tuple[int, int, int]]], before: Totals | None) -> Totals:
    split = {k % (1 << 64): v for k, v in found[1].items() if v[0]}
    plain = {k: found[2].get(k, (0, 0, 0)) for k in range(4)}

    def discount(k: int) -> float:
        once, twice = plain[k][:2]
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    return replace(
        _nothing(), tokens=plain[0][1], vocabulary=plain[0][0] + len(split),
        root_customers=plain[1][0] + sum(v[1] for v in split.values()),
        root_tables=plain[1][1] + sum(v[2] for v in split.values()),
        discount=before.discount if before else discount(2),
        root_discount=before.root_discount if before else discount(3), split=split,
    )


_PARTS = "chunk long, docs binary, known binary, base binary, score binary, train int, ids array<long>, n binary"


def _parts(state: DataFrame, totals: Totals, homes: int) -> DataFrame:
    """Sums per (shard, document), packed by chunk."""
    shared = state.sparkSession.sparkContext.broadcast(totals)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield _part(row, _own_totals(row, shared.value, homes))

    columns = [*_LIGHT, "customers", "tables", "tokens", "token_chunks", "token_docs", "chunks"]
    return state.select(*columns).mapInPandas(total, _PARTS)


def _part(row: dict, totals: Totals) -> pd.DataFrame:
    chain = Chain(_opened(row), totals)
    mean = np.zeros(len(chain.count))
    for _ in chain.run(BURN_IN, SAMPLES):
        mean += chain.probability()
    log = np.log10(mean / SAMPLES)
    known = chain.known.astype(float)
    for i, (tokens, _, _) in chain.share:
        known[i] = tokens
    base = np.log10((known + 0.5) / (totals.tokens + 0.5 * (totals.vocabulary + 1)))
    tokens = _unpacked(row["tokens"], np.uint32)
    token_docs = _unpacked(row["token_docs"], np.uint16)
    doc = _read_places(row["token_chunks"], len(token_docs)).astype(np.int64) << 16 | token_docs
    docs, which = np.unique(doc, return_inverse=True)
    sums = [np.bincount(which, np.repeat(x, tokens), len(docs)) for x in (known[chain.dish] > 0, base[chain.dish], log)]
    cuts = np.searchsorted(docs >> 16, np.arange(len(row["chunks"]) + 1))
    return pd.DataFrame([
        (chunk, _packed(_steps((docs[a:b] & 0xFFFF).astype(np.uint16))), _packed(sums[0][a:b].astype(np.uint32)),
         sums[1][a:b].tobytes(), sums[2][a:b].astype(np.float32).tobytes(), None, None, None)
        for chunk, a, b in zip(row["chunks"], cuts[:-1], cuts[1:]) if b > a
    ], columns=[part.split()[0] for part in _PARTS.split(", ")])


def score_documents(
    docs: DataFrame, held_out: Column, tokens_per_shard: int = TOKENS_PER_SHARD
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from rows where ``held_out`` isn't true and scores all of them. Tokens are
    words (split at ASCII white space, A-Z in lower case) and one end per document, so a
    null or empty text has one token. ``score`` is the log10 probability of the text by
    the mean of SAMPLES seatings, ``base_score`` by smoothed word counts. Words are told
    apart by 64-bit hashes. Null ids stay null; repeated rows are scored, and learned
    from, as often as they occur; other columns are ignored; an empty table gives an
    empty one. Without training rows every known count is 0 and words are uniform.
    """
    layout = plan_layout(docs, tokens_per_shard)
    state = gather(deal(docs, F.coalesce(held_out, F.lit(False)), layout), layout.shards)
    splits = frozenset(layout.splits)
    seated = state.where("words is not null")
    pairs = seated.agg(F.coalesce(F.sum(F.octet_length("restaurants")), F.lit(0))).first()[0] // 8
    homes = max(1, -(-pairs // PAIRS_PER_HOME))
    _drop_shuffles(docs.sparkSession)
    place = scratch_path(docs.sparkSession, "lm-totals")
    merged, found = _sums(seated, None, splits, homes, place)
    totals = _totals(found, None)
    for _ in range(ROUNDS - 1):
        before, place = place, scratch_path(docs.sparkSession, "lm-totals")
        merged, found = _sums(_joined(seated.select(*_LIGHT), merged), totals, splits, homes, place)
        delete(docs.sparkSession, before)
        totals = _totals(found, totals)
        _drop_shuffles(docs.sparkSession)
    n_train = totals.tokens
    infos = state.where("words is null").select(
        "chunk", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "known", "base", "score")], "train", "ids", "n"
    )

    def total(group: pd.DataFrame) -> pd.DataFrame:
        info = group[group["n"].notna()].iloc[0]
        n = np.frombuffer(info["n"], np.uint32).astype(np.int64)
        sums = np.zeros((3, len(n)))
        for row in group[group["n"].isna()].itertuples():
            at = _summed(_unpacked(row.docs, np.uint16))
            sums[0][at] += _unpacked(row.known, np.uint32)
            sums[1][at] += np.frombuffer(row.base, np.float64)
            sums[2][at] += np.frombuffer(row.score, np.float32)
        return pd.DataFrame({
            "doc_id": pd.array(list(info["ids"]), "Int64"), "held_out": np.arange(len(n)) >= info["train"], "n_tokens": n,
            "n_known": sums[0].astype(np.int64), "train_tokens": n_train, "base_score": sums[1], "score": sums[2],
        })

    return _parts(_joined(seated, merged), totals, homes).unionByName(infos).groupBy("chunk").applyInPandas(
        total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
