"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are laid out in Gray order, where neighbours differ in few bits.
The upper index is a trie over Gray ranks whose leaves are the partitions: a leaf is a
run of Gray ranks that shares its leading bits. A fingerprint visits each leaf whose
shared bits it matches up to the allowed distance. In a leaf, consecutive fingerprints
form groups of ``FANOUT``, groups form groups again, and each group keeps the bits its
members share and its parent does not. A search adds up the differences on the way
down and drops a whole group once they exceed the distance.

Leaves return a spanning forest of the links they find, so the output is linear in the
fingerprints however many pairs a dense group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambilens.llm.components import connected_components
from ambilens.session import stage

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints of a leaf of the upper index; the trie has at most MAX_LEAVES leaves
#: (leaves then grow instead).
LEAF_ROWS = 8192
MAX_LEAVES = 16384
#: Bits of Gray rank by which a dense cell of the trie is split at a time.
STEP = 12
FANOUT = 16
FRONTIER = 1 << 20

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bit vector of the shingles' XXH64; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=">u8", count=len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every document; null texts count as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter(
                (fingerprint((t.as_py() or "").encode(), shingle) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of 64-bit codes in Gray order: each bit is the parity of the bits above."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _cells(ranked: DataFrame, rows: int) -> list[tuple[int, int]]:
    """Leaves (prefix length, prefix) of the upper trie over Gray ranks.

    Each step counts the next ``STEP`` bits below the cells that are still too large;
    their number is at most MAX_LEAVES as each holds more than a leaf's rows.
    """
    leaves: list[tuple[int, int]] = []
    dense: list[tuple[int, int]] = [(0, 0)]
    depth = 0
    while dense:
        width = min(STEP, 64 - depth)
        prefix = F.shiftrightunsigned("rank", 64 - depth) if depth else F.lit(0).cast("long")
        cell = F.shiftrightunsigned("rank", 64 - depth - width).bitwiseAND((1 << width) - 1)
        here = ranked.select(prefix.alias("p"), cell.alias("c"))
        if depth:
            table = ranked.sparkSession.createDataFrame([(p,) for _, p in dense], "p long")
            here = here.join(F.broadcast(table), "p")
        counts: dict[int, dict[int, int]] = {}
        for row in here.groupBy("p", "c").count().collect():
            counts.setdefault(row.p, {})[row.c] = row[2]
        deeper = []
        for _, p in dense:
            found = np.zeros(1 << width, np.int64)
            for c, n in counts.get(p, {}).items():
                found[c] = n
            sums = np.concatenate([[0], np.cumsum(found)])
            stack = [(0, 0)]
            while stack:
                bits, q = stack.pop()
                span = 1 << (width - bits)
                n = sums[(q + 1) * span] - sums[q * span]
                if n <= rows or depth + bits == 64:
                    leaves.append((depth + bits, (p << bits) | q))
                elif bits == width:
                    deeper.append((depth + width, (p << width) | q))
                else:
                    stack += [(bits + 1, 2 * q), (bits + 1, 2 * q + 1)]
        dense, depth = deeper, depth + width
    return sorted(leaves, key=lambda leaf: leaf[1] << (64 - leaf[0]))


class _Upper:
    """The trie with the shared code bits of each node."""

    def __init__(self, leaves: list[tuple[int, int]]) -> None:
        self.child: list[list[int]] = [[-1, -1]]
        self.leaf: list[int] = [-1]
        for number, (depth, prefix) in enumerate(leaves):
            node = 0
            for level in range(depth):
                bit = (prefix >> (depth - 1 - level)) & 1
                if self.child[node][bit] < 0:
                    self.child[node][bit] = len(self.leaf)
                    self.child.append([-1, -1])
                    self.leaf.append(-1)
                node = self.child[node][bit]
            self.leaf[node] = number

    def visit(self, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether the row's own leaf) within ``distance`` on the shared bits.

        Descending to a rank bit fixes one more code bit: the rank bit exclusive-or the
        one above it.
        """
        child, leaf = np.array(self.child), np.array(self.leaf)
        row = np.arange(len(codes))
        node, above, off = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int8)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(65):
            done = leaf[node] >= 0
            out.append((row[done], leaf[node[done]], off[done] == 0))
            row, node, above, off = row[~done], node[~done], above[~done], off[~done]
            if not len(row):
                break
            own = ((codes[row] >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)
            parts = []
            for rank_bit in (0, 1):
                differs = off + ((rank_bit ^ above) != own)
                keep = (differs <= distance) & (child[node, rank_bit] >= 0)
                parts.append((row[keep], child[node[keep], rank_bit], np.full(keep.sum(), rank_bit), differs[keep].astype(np.int8)))
            row, node, above, off = (np.concatenate(x) for x in zip(*parts))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, value) of groups, from single codes up; masks without the parent's bits."""
    same, value = [np.full(len(codes), _FULL)], [codes]
    while len(same[-1]) > 1:
        starts = np.arange(0, len(same[-1]), FANOUT)
        each_and = np.bitwise_and.reduceat(value[-1], starts)
        each_or = np.bitwise_or.reduceat(value[-1] | ~same[-1], starts)
        mask = ~(each_and ^ each_or) & np.bitwise_and.reduceat(same[-1], starts)
        same.append(mask)
        value.append(each_and & mask)
    out = []
    for level in range(len(same)):
        parent = same[level + 1].repeat(FANOUT)[: len(same[level])] if level + 1 < len(same) else np.uint64(0)
        out.append((same[level] & ~parent, value[level]))
    return out


def leaf_links(members: np.ndarray, visitors: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (member, other) within ``distance``: visitors then members against members.

    ``members`` must be in Gray order. Pairs come in blocks; a member also meets itself.
    """
    levels = _levels(members)
    codes = np.concatenate([members, visitors])
    step = max(1, FRONTIER // (FANOUT * 64))
    for at in range(0, len(codes), step):
        queries = codes[at : at + step]
        row, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        yield from _descend(levels, len(levels) - 1, queries, row, node, np.zeros(len(row), np.int64), members, distance)


def _descend(levels, level, queries, row, node, off, members, distance):
    while True:
        mask, value = levels[level]
        off = off + np.bitwise_count((queries[row] ^ value[node]) & mask[node])
        keep = off <= distance
        row, node, off = row[keep], node[keep], off[keep]
        if not level:
            yield members[node], queries[row]
            return
        level -= 1
        if len(row) * FANOUT > FRONTIER and len(row) > 1:
            half = len(row) // 2
            for part in (slice(None, half), slice(half, None)):
                yield from _descend(levels, level, queries, *_children(levels, level, row[part], node[part], off[part]), members, distance)
            return
        row, node, off = _children(levels, level, row, node, off)


def _children(levels, level, row, node, off):
    child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    row, off = row.repeat(FANOUT), off.repeat(FANOUT)
    real = child < len(levels[level][1])
    return row[real], child[real], off[real]


def _forest(codes: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, root) of sorted ``codes`` joined by ``pairs``, without codes that stay alone."""
    label = np.arange(len(codes))
    for left, right in pairs:
        a, b = np.searchsorted(codes, left), np.searchsorted(codes, right)
        while True:
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    moved = label != np.arange(len(codes))
    return codes[moved], codes[label[moved]]


def links(distinct: DataFrame, distance: int = DISTANCE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Forest ``a, b`` of links among distinct fingerprints ``fp`` (a stored table).

    Its components are those of all pairs that differ in ``distance`` bits or fewer.
    """
    ranked = distinct.select(_gray_rank("fp").alias("rank"))
    total = distinct.count()
    leaves = _cells(ranked, max(leaf_rows, -(-total // MAX_LEAVES)))
    upper = distinct.sparkSession.sparkContext.broadcast(_Upper(leaves))  # at most 128 * MAX_LEAVES nodes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.asarray(batch.column("fp")).view(np.uint64)
            row, leaf, own = upper.value.visit(codes, distance)
            home = np.empty(len(codes), np.int64)
            home[row[own]] = leaf[own]
            # A pair in two leaves is met once: in the leaf of smaller number.
            keep = leaf <= home[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf[keep].astype(np.int32)), pa.array(codes[row[keep]].view(np.int64)), pa.array(own[keep])],
                ["leaf", "fp", "own"],
            )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        codes = group["fp"].to_numpy().view(np.uint64)
        own = group["own"].to_numpy()
        members = codes[own]
        members = members[np.argsort(gray_rank(members))]
        everyone = np.sort(codes)
        if len(members):
            code, root = _forest(everyone, leaf_links(members, codes[~own], distance))
        else:
            code = root = np.zeros(0, np.uint64)
        return pd.DataFrame({"a": code.view(np.int64), "b": root.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf int, fp long, own boolean")
    return dealt.groupBy("leaf").applyInPandas(search, "a long, b long")


def _gray_rank(name: str):
    """Gray rank as built-in expressions; a chain of six steps over named columns would copy
    its input 64 times, so a fold over the shifts keeps it short."""
    shifts = F.array(*[F.lit(s) for s in (1, 2, 4, 8, 16, 32)])
    return F.aggregate(shifts, F.col(name), lambda acc, s: acc.bitwiseXOR(F.call_function("shiftrightunsigned", acc, s)))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    Documents link at ``distance`` or fewer differing bits; the component is the smallest
    doc_id that links reach. Null texts count as empty; empty texts have fingerprint 0,
    which links like any other. Null doc_ids stay null and don't count for the smallest;
    a component of null ids only has a null component_id. Repeated rows stay as often as they occur; other columns are ignored.
    Copies meet as one fingerprint with its smallest doc_id, never as pairs.
    """
    return groups(docs, shingle, distance, leaf_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def groups(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """``doc_id, fp, component, component_id`` for every row, as in ``near_duplicates``.

    ``component`` tells groups apart where repeated doc_ids give them the same smallest one.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    components = connected_components(links(distinct, distance, leaf_rows))
    # Of the distinct fingerprints, only those with a link to another are in ``components``.
    grouped = distinct.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = stage(grouped.join(smallest, "component").select("fp", "component", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component", "component_id")
