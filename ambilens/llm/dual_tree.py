"""Exact ranked lexical search by two trees: one over the items, one over documents.

A node of either tree holds the largest value that any leaf below it has in each
coordinate (term). The product of an item node and a document node bounds every score
between their leaves, so where it is below the weakest k-th best score of the node's items,
the whole batch of pairs is left out; scores of the pairs that remain are computed in
full. All numbers are 64-bit integers, so bounds and scores have no rounding.

Documents form a tree per piece of a partition; the items' best scores so far carry over
from piece to piece, and the best of all partitions are merged.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ambilens.llm.common import chunks
from ambilens.session import stage

K = 10
FAN = 4
#: Bytes of item texts that are searched for at a time, and of postings in a document tree.
ITEM_BYTES, TREE_BYTES = 16 * 1024 * 1024, 2 * 1024 * 1024
#: Items that are scored against a leaf's documents at a time.
SCORED_ITEMS = 256

_LETTERS_DIGITS = bytes(b for b in range(0x80) if chr(b).isalnum())
_TERM_BYTES = bytes(
    ord(chr(b).lower()) if b in _LETTERS_DIGITS else b if b >= 0x80 else 0x20 for b in range(256)
)
_POSTINGS = "doc_id long, n long, terms binary, counts binary"
_FOUND = "item_id long, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; A-Z in lower case.

    >>> terms_of("Ab-c9 É_x".encode()) == [b"ab", b"c9", "É".encode(), b"x"]
    True
    """
    return (text or b"").translate(_TERM_BYTES).split()


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of [start, end) ranges, one after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


@dataclass
class Level:
    """Sparse rows: node i has ``term[start[i]:start[i + 1]]`` and their values; none is empty."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def row(self, node: int) -> slice:
        return slice(self.start[node], self.start[node + 1])

    def entries(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' values, and where each node's first one is among them."""
        size = self.start[nodes + 1] - self.start[nodes]
        return ranges(self.start[nodes], self.start[nodes + 1]), np.cumsum(size) - size

    def products(self, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        entries, first = self.entries(nodes)
        return np.add.reduceat(self.value[entries] * dense[self.term[entries]], first)


class Tree:
    """Levels from the leaves (0) to one root; FAN neighbours share a parent.

    Leaves are put in order of the term that weighs most in them, so that neighbours are
    alike and their maxima stay low. ``order`` tells which row each leaf was.
    """

    def __init__(self, sizes: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray) -> None:
        n_terms = len(weight)
        owner, share = np.repeat(np.arange(len(sizes)), sizes), weight[term] * value
        by_share = np.lexsort((-share, owner))
        strongest = by_share[np.cumsum(sizes) - sizes]
        self.order = np.lexsort((-share[strongest], term[strongest]))
        start = np.concatenate([[0], np.cumsum(sizes)])
        moved = ranges(start[self.order], start[self.order + 1])
        level = Level(np.concatenate([[0], np.cumsum(sizes[self.order])]), term[moved], value[moved])
        self.levels = [level]
        while len(level) > 1:
            parent = np.repeat(np.arange(len(level)) // FAN, np.diff(level.start))
            key = parent * n_terms + level.term
            at = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]]))
            key = key[at][first]
            counts = np.bincount(key // n_terms)
            level = Level(
                np.concatenate([[0], np.cumsum(counts)]), key % n_terms, np.maximum.reduceat(level.value[at], first)
            )
            self.levels.append(level)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of the level below."""
        return ranges(nodes * FAN, np.minimum(nodes * FAN + FAN, len(self.levels[level - 1])))


@dataclass
class Items:
    """The items of one search: their tree, and the terms' weights."""

    ids: list[int]
    tree: Tree
    weight: np.ndarray
    n_documents: int
    n_terms: int

    def impacts(self, n: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each term weighs in a document of ``n`` terms, before its weight."""
        # Python's numbers: the product may pass 64 bits before it is divided.
        lengths = np.array([25 + 75 * int(x) * self.n_documents // self.n_terms for x in n], np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(lengths, sizes))


@dataclass
class Search:
    """Best documents of all items so far, over any number of document trees."""

    items: Items
    k: int = K
    scored: int = 0  # pairs whose scores were computed
    scores: np.ndarray = field(init=False)
    docs: np.ndarray = field(init=False)
    weakest: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        levels = self.items.tree.levels
        self.scores = np.zeros((len(levels[0]), self.k), np.int64)
        self.docs = np.full((len(levels[0]), self.k), np.iinfo(np.int64).max)
        self.weakest = [np.zeros(len(level), np.int64) for level in levels]
        self.place = np.full(len(self.items.weight), -1, np.int64)
        self.dense = np.zeros(len(self.items.weight), np.int64)

    def add(self, doc_ids: np.ndarray, tree: Tree) -> None:
        self.tree, self.doc_ids = tree, doc_ids[tree.order]
        top = len(self.items.tree.levels) - 1
        root, above = len(tree.levels) - 1, np.zeros(1, np.int64)
        self._visit(root, 0, top, above, self._bounds(root, 0, top, above))

    def _bounds(self, level: int, node: int, item_level: int, nodes: np.ndarray) -> np.ndarray:
        docs = self.tree.levels[level]
        row = docs.row(node)
        self.dense[docs.term[row]] = docs.value[row]
        found = self.items.tree.levels[item_level].products(nodes, self.dense)
        self.dense[docs.term[row]] = 0
        return found

    def _visit(self, level: int, node: int, item_level: int, nodes: np.ndarray, bounds: np.ndarray) -> None:
        """Pairs of a document node with item nodes; ``bounds`` were made for them."""
        # An equal score still counts, as the smaller id wins.
        left = (bounds > 0) & (bounds >= self.weakest[item_level][nodes])
        nodes = nodes[left]
        if not len(nodes):
            return
        if item_level:
            nodes, item_level = self.items.tree.children(item_level, nodes), item_level - 1
        elif level <= 1:
            self._score(level, node, nodes)
            return
        if level <= 1:
            self._visit(level, node, item_level, nodes, self._bounds(level, node, item_level, nodes))
            return
        below = self.tree.children(level, np.array([node]))
        each = [self._bounds(level - 1, child, item_level, nodes) for child in below]
        # The children that promise most come first: they raise the scores to beat.
        for at in np.argsort([-bound.sum() for bound in each], kind="stable"):
            self._visit(level - 1, int(below[at]), item_level, nodes, each[at])

    def _score(self, level: int, node: int, items: np.ndarray) -> None:
        """All documents below a node of level 0 or 1 against single items."""
        leaves, all_items = self.tree.levels[0], self.items.tree.levels[0]
        low = node * FAN if level else node
        high = min(low + FAN, len(leaves)) if level else low + 1
        rows = slice(leaves.start[low], leaves.start[high])
        held, column = np.unique(leaves.term[rows], return_inverse=True)
        impact, first = leaves.value[rows], leaves.start[low:high] - leaves.start[low]
        self.place[held] = np.arange(len(held))
        for at in range(0, len(items), SCORED_ITEMS):
            some = items[at : at + SCORED_ITEMS]
            entries, _ = all_items.entries(some)
            row = np.repeat(np.arange(len(some)), np.diff(all_items.start)[some])
            where = self.place[all_items.term[entries]]
            values = np.zeros((len(some), len(held)), np.int64)
            values[row[where >= 0], where[where >= 0]] = all_items.value[entries][where >= 0]
            self._keep(some, np.add.reduceat(values[:, column] * impact, first, axis=1), self.doc_ids[low:high])
            self.scored += len(some) * (high - low)
        self.place[held] = -1

    def _keep(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        better = (scores.max(axis=1) >= self.weakest[0][items]) & (scores.max(axis=1) > 0)
        items, scores = items[better], scores[better]
        if not len(items):
            return
        every = np.concatenate([self.scores[items], scores], axis=1)
        ids = np.concatenate([self.docs[items], np.broadcast_to(docs, scores.shape)], axis=1)
        ids = np.where(every > 0, ids, np.iinfo(np.int64).max)
        order = np.lexsort((ids, -every), axis=1)[:, : self.k]
        self.scores[items] = np.take_along_axis(every, order, axis=1)
        self.docs[items] = np.take_along_axis(ids, order, axis=1)
        self.weakest[0][items] = self.scores[items, -1]
        changed = items
        for level in range(1, len(self.weakest)):
            changed = np.unique(changed // FAN)
            below = self.weakest[level - 1]
            for parent in changed:
                self.weakest[level][parent] = below[parent * FAN : parent * FAN + FAN].min()

    def found(self) -> pa.RecordBatch:
        item, rank = np.nonzero(self.scores)
        ids = np.array(self.items.ids, np.int64)[self.items.tree.order]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[item]), pa.array(self.docs[item, rank]), pa.array(self.scores[item, rank])],
            ["item_id", "doc_id", "score"],
        )


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n`` (terms with repeats) and numbers and counts of the terms in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # ITEM_BYTES of text at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = defaultdict(lambda: -1, shared.value)
        get = known.get
        for batch in batches:
            for part in chunks(batch):
                n, terms, counts = [], [], []
                for text in part.column("text").to_pylist():
                    found = terms_of(text)
                    n.append(len(found))
                    numbers = np.fromiter((get(x, -1) for x in found), np.int64, len(found))
                    term, times = np.unique(numbers[numbers >= 0], return_counts=True)
                    terms.append(term.astype(np.int32).tobytes())
                    counts.append(times.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                    ["doc_id", "n", "terms", "counts"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(count, _POSTINGS)


def _joined(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64)


def _document_counts(found: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: one sum per task, then over tasks."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in chunks(batch, "terms"):
                total += np.bincount(_joined(part.column("terms")), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = found.select("terms").mapInArrow(add_up, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_terms, np.int64)
    for row in rows:  # one per term of the items
        counts[row.term] = row.n
    return counts


def prepare(bags: dict[int, Counter], vocabulary: dict[bytes, int], held: np.ndarray, n: int, length: int) -> Items:
    """The items' tree, for ``held`` documents per term, of ``n`` with ``length`` terms in all."""
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    ids = sorted(bags)
    sizes = np.array([len(bags[i]) for i in ids], np.int64)
    term = np.array([vocabulary[t] for i in ids for t in bags[i]], np.int64)
    times = np.array([c for i in ids for c in bags[i].values()], np.int64)
    return Items(ids, Tree(sizes, term, times * weight[term], np.ones(len(weight), np.int64)), weight, n, length)


def _search_block(docs: DataFrame, bags: dict[int, Counter], k: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    for bag in bags.values():
        for term in bag:
            vocabulary.setdefault(term, len(vocabulary))
    found = stage(postings(docs, vocabulary), "lexical-postings")
    n, length = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return docs.sparkSession.createDataFrame([], _FOUND)
    items = prepare(bags, vocabulary, _document_counts(found, len(vocabulary)), n, length)
    shared = docs.sparkSession.sparkContext.broadcast(items)  # grows with ITEM_BYTES alone

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, k)
        for batch in batches:
            for part in chunks(batch, "terms", TREE_BYTES):
                add_documents(search, part)
        yield search.found()

    held = found.where("doc_id is not null and octet_length(terms) > 0")
    return held.mapInArrow(find, _FOUND)


def add_documents(search: Search, part: pa.RecordBatch) -> None:
    """The documents of a piece, as one tree."""
    term, counts = _joined(part.column("terms")), _joined(part.column("counts"))
    sizes = np.array([len(x) // 4 for x in part.column("terms").to_pylist()], np.int64)
    impact = search.items.impacts(part.column("n").to_numpy(), counts, sizes)
    search.add(part.column("doc_id").to_numpy(), Tree(sizes, term, impact, search.items.weight))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    Statistics are those of all rows of ``docs`` with a term. Rows of ``items`` that share
    an item_id are one item with the terms of all; a null item_id is none. Rows of ``docs``
    are documents of their own, also where they repeat; those without doc_id count for the
    statistics but are no result. Null and empty texts match nothing. Equal scores go by
    doc_id. Other columns are ignored; empty tables give an empty one. Items are taken in
    blocks of about ITEM_BYTES, each against all documents.
    """
    spark = docs.sparkSession
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    size, = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // ITEM_BYTES))
    each = spark.createDataFrame([], _FOUND)
    for block in range(blocks):
        bags: dict[int, Counter] = defaultdict(Counter)
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            bags[row.item_id].update(terms_of(row.text))
        bags = {item: bag for item, bag in bags.items() if bag}
        if bags:
            each = each.unionByName(stage(_search_block(docs, bags, k), "lexical-found"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
