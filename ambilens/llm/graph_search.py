"""Approximate nearest neighbours by largest inner product: robust-pruned graphs.

Distinct vectors are hashed to shards of about SHARD_ROWS. Each shard builds a directed
graph: vectors are inserted in growing batches, a greedy search over the graph so far
proposes neighbours, and relaxed pruning (ALPHA) keeps those that no kept one is clearly
nearer to. Queries go to every shard in blocks, a beam search walks the shard's graph,
and the best of all shards are merged.

Inner products become distances by one more coordinate that gives all vectors of a shard
the same length. Where vectors aren't clustered, or their lengths differ, the nearest of a
query need not be near each other, so each shard measures its recall on a sample of its
vectors against exact search in the shard. Below RECALL it gets edges of a second kind, to
what a query with the node's vector would find, and if needed a wider beam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambilens.session import stage

SHARD_ROWS = 8192
DEGREE = 32
ALPHA = 1.2
#: Pruning of edges toward a query: nodes are nearer to each other than to it, so only those
#: much nearer to each other stand for one another.
QUERY_ALPHA = 4.0
BUILD_BEAM = 64
#: The narrowest beam; a shard's own is this times a power of two, up to all its nodes.
SEARCH_BEAM = 96
RECALL, SAMPLE = 0.96, 128
WIDTH = 4
BATCH = 512
QUERY_BLOCK = 4096
MAX_DIMENSIONS = 1000

_INDEX = "dim int, shard int, entry int, beam int, vectors binary, edges binary, members binary, ids binary"


def usable(vector: str) -> Column:
    """Not null, not zero, and all components present and finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def beam_search(
    base: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities (descending; -1 and -inf as padding) for each query.

    All queries walk in step; each step expands the WIDTH best nodes not yet expanded.
    """
    count, width = len(queries), min(WIDTH, beam)
    rows = np.arange(count)
    nodes = np.full((count, beam), -1)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    seen = np.zeros((count, len(base)), bool)
    nodes[:, 0], near[:, 0], done[:, 0] = entry, queries @ base[entry], False
    seen[:, entry] = True
    active = rows
    while len(active):
        order = np.argsort(done[active], axis=1, kind="stable")[:, :width]
        fresh = ~done[active[:, None], order]
        done[active[:, None], order] = True
        found = np.where(fresh[:, :, None], edges[nodes[active[:, None], order]], -1).reshape(len(active), -1)
        real = (found >= 0) & ~seen[active[:, None], found]
        # A node that several expanded nodes point to counts once.
        sorted_ = np.argsort(found, axis=1, kind="stable")
        twice = np.zeros_like(real)
        in_order = np.take_along_axis(found, sorted_, 1)
        np.put_along_axis(twice, sorted_[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
        real &= ~twice
        at, where = np.nonzero(real)
        target = found[at, where]
        seen[active[at], target] = True
        close = np.full(found.shape, -np.inf, np.float32)
        close[at, where] = np.einsum("ij,ij->i", base[target], queries[active[at]])
        all_near = np.concatenate([near[active], close], axis=1)
        best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_near, best, 1), axis=1, kind="stable"), 1)
        near[active] = np.take_along_axis(all_near, best, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], np.where(real, found, -1)], axis=1), best, 1)
        flags = np.concatenate([done[active], ~real], axis=1)
        done[active] = np.take_along_axis(flags, best, 1)
        active = active[~done[active].all(axis=1)]
    return nodes, near


def robust_prune(base: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA,
                 toward: np.ndarray | None = None) -> np.ndarray:
    """Up to ``degree`` candidates for each point, or for its row in ``toward``; -1 as padding.

    The nearest one left is kept and removes all that it is nearer to, by a factor of
    ``alpha``, than the point is.
    """
    own = candidates == points[:, None]
    vectors = base[candidates]
    to_point = 2 - 2 * np.einsum("bcd,bd->bc", vectors, base[points] if toward is None else toward)
    to_point[own | (candidates < 0)] = np.inf
    order = np.argsort(to_point, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    to_point = np.take_along_axis(to_point, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    open_ = np.isfinite(to_point)
    kept = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        some = open_.any(axis=1)
        if not some.any():
            break
        first = open_.argmax(axis=1)
        kept[some, k] = candidates[rows[some], first[some]]
        covered = alpha * alpha * np.maximum(between[rows, first], 0) <= to_point
        open_ &= ~(covered & some[:, None])
        open_[rows, first] = False
    return kept


def build_graph(base: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 as padding) and the entry node of unit vectors ``base``."""
    n = len(base)
    entry = int(np.argmax(base @ base.mean(axis=0)))
    if n <= degree + 1:
        edges = np.full((n, degree), -1)
        for i in range(n):
            others = np.delete(np.arange(n), i)
            edges[i, : len(others)] = others
        return edges, entry
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        found, _ = beam_search(base, edges, entry, base[batch], beam)
        # Members of the batch don't see each other in the graph, but may be neighbours.
        edges[batch] = robust_prune(base, batch, found, degree)
        _link_back(base, edges, batch, degree)
        at += size
        size = min(size * 2, BATCH)
    # A second pass over all points with the whole graph in place.
    for at in range(0, n, BATCH):
        batch = order[at : at + BATCH]
        found, _ = beam_search(base, edges, entry, base[batch], beam)
        edges[batch] = robust_prune(base, batch, np.concatenate([found, edges[batch]], axis=1), degree)
        _link_back(base, edges, batch, degree)
    return edges, entry


def _link_back(base: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int) -> None:
    """Give each new neighbour an edge back, pruning where it has too many."""
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (edges[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    node, first, count = np.unique(target, return_index=True, return_counts=True)
    used = (edges[node] >= 0).sum(axis=1)
    most = 4 * degree
    for group in np.array_split(np.arange(len(node)), max(1, len(node) // BATCH)):
        width = int(min(most, count[group].max(initial=0)))
        offset = np.arange(width)
        have = offset < count[group][:, None]
        more = np.where(have, source[np.minimum(first[group][:, None] + offset, len(source) - 1)], -1)
        both = np.concatenate([edges[node[group]], more], axis=1)
        full = used[group] + count[group] > degree
        if full.any():
            edges[node[group][full]] = robust_prune(base, node[group][full], both[full], degree)
        if (~full).any():
            packed = np.sort(-both[~full], axis=1)  # real nodes are 0 or less, padding is 1
            edges[node[group][~full]] = -packed[:, :degree]


def _dense(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors on the unit sphere, with one coordinate more, in order of inner products."""
    scaled = vectors / np.abs(vectors).max()  # squares of very large components would be infinite
    scaled /= np.sqrt((scaled * scaled).sum(axis=1)).max()
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
    return np.concatenate([scaled, rest[:, None]], axis=1).astype(np.float32)


def _flat(queries: np.ndarray) -> np.ndarray:
    """Queries of length 1 in the space of ``_unit``."""
    scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
    scaled /= np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return np.concatenate([scaled, np.zeros((len(queries), 1))], axis=1).astype(np.float32)


def widened(base: np.ndarray, flat: np.ndarray, edges: np.ndarray, entry: int, degree: int = DEGREE) -> np.ndarray:
    """Edges, then up to ``degree`` to what the node's vector finds as a query, and as many back."""
    n = len(base)
    ahead = np.full((n, degree), -1)
    for at in range(0, n, BATCH):
        batch = np.arange(at, min(n, at + BATCH))
        found, _ = beam_search(base, edges, entry, flat[batch], min(n, 2 * SEARCH_BEAM))
        ahead[batch] = robust_prune(base, batch, found, degree, QUERY_ALPHA, flat[batch])
    source, target = np.repeat(np.arange(n), degree), ahead.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", flat[source], base[target]), target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target, "left")
    back = np.full((n, degree), -1)
    back[target[rank < degree], rank[rank < degree]] = source[rank < degree]
    return np.concatenate([edges, ahead, back], axis=1)


def fitted_graph(vectors: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, int, int]:
    """Edges, entry node and beam with which a sample of SAMPLE nodes finds RECALL of its ``k`` nearest.

    The beam is ``beam`` times a power of two, or all nodes if less doesn't do.
    """
    base, flat = _unit(vectors), _flat(vectors)
    edges, entry = build_graph(base)
    n = len(base)
    k = min(k, n)
    asked = flat[np.random.default_rng(n).choice(n, min(n, SAMPLE), replace=False)]
    # Scores of one kind on both sides, so that equally near nodes stand for each other.
    exact = asked @ base.T
    border = np.partition(exact, n - k, axis=1)[:, n - k, None]

    def recall(edges: np.ndarray, beam: int) -> float:
        nodes, _ = beam_search(base, edges, entry, asked, beam)
        hits = (np.take_along_axis(exact, nodes, 1) >= border) & (nodes >= 0)
        return float(np.minimum(hits.sum(axis=1), k).mean() / k)

    if beam < n and recall(edges, beam) < RECALL:
        edges = widened(base, flat, edges, entry)
    while beam < n and recall(edges, beam) < RECALL:
        beam *= 2
    return edges, entry, min(beam, n)


def classes(embeddings: DataFrame, keep: int) -> DataFrame:
    """``dim, hash, vector, ids``: distinct vectors and their ``keep`` smallest vec_ids.

    Rank limits apply before the shuffle, so a vector that a third of all rows share
    sends ``keep`` rows per task.
    """
    rows = embeddings.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        "vec_id", F.col("embedding").alias("vector"), F.xxhash64("embedding").alias("hash")
    )
    first = Window.partitionBy("hash", "vector").orderBy("vec_id")
    return (
        rows.withColumn("__n", F.dense_rank().over(first)).where(F.col("__n") <= keep)
        .groupBy("hash", "vector").agg(F.collect_set("vec_id").alias("ids"))
        .withColumn("dim", F.size("vector"))
    )


def build_index(
    embeddings: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM
) -> tuple[DataFrame, dict[int, int]]:
    """Stored index, one row per shard, and the number of shards per dimension."""
    distinct = stage(classes(embeddings, keep), "vectors")
    sizes = {r.dim: r["count"] for r in distinct.groupBy("dim").count().limit(MAX_DIMENSIONS + 1).collect()}
    if len(sizes) > MAX_DIMENSIONS:
        raise ValueError(f"Vectors of more than {MAX_DIMENSIONS} lengths")
    shards = {dim: -(-n // shard_rows) for dim, n in sizes.items()}
    if not shards:
        return distinct.sparkSession.createDataFrame([], _INDEX), {}
    number = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors = _dense(group["vector"])
        edges, entry, wide = fitted_graph(vectors, keep, beam)
        ids = [np.sort(np.asarray(i, np.int64)) for i in group["ids"]]
        return pd.DataFrame([(
            key[0], key[1], entry, wide, vectors.tobytes(), edges.astype(np.int32).tobytes(),
            np.array([len(i) for i in ids], np.int32).tobytes(), np.concatenate(ids).tobytes(),
        )], columns=[f.split()[0] for f in _INDEX.split(", ")])

    dealt = distinct.withColumn("shard", F.pmod(F.col("hash"), number[F.col("dim")]).cast("int"))
    spread = dealt.repartition(sum(shards.values()), "dim", "shard")
    return stage(spread.groupBy("dim", "shard").applyInPandas(build, _INDEX), "graphs"), shards


def search(
    embeddings: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows found nearest to each query row.

    Nearest is the largest inner product of the original vectors in double precision,
    ties to the smaller vec_id; a row isn't its own neighbour, nor are rows with its
    vec_id. Rows without vec_id, and vectors that are null, zero or hold null or
    non-finite components, are neither queries nor found. Only vectors of the query's
    length are. Equal vectors are one node of the graph with its ``k + 1`` smallest
    vec_ids, which is all that a result can hold. With fewer rows than ``k``, all are
    found. Rows that repeat a vec_id and its vector count once; a vec_id with several
    vectors asks with the smallest of them and is found once, by the nearest. ``beam`` is
    the narrowest one; shards widen theirs as they measure. Other columns are ignored.
    """
    index, shards = build_index(embeddings, k + 1, shard_rows, beam)
    asked = (
        embeddings.where(usable("embedding") & F.col("vec_id").isNotNull() & is_query)
        .groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("vector"))
        .withColumn("dim", F.size("vector"))
    )
    out = "query_id long, vec_id long, score double"
    if not shards:
        empty = asked.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
        return _ranked(empty, k)
    asked = stage(asked, "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    number = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
    queries = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), number[F.col("dim")] - 1))
    )
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = blocks * sum(shards.values())

    def find(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(graph):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return pd.concat(_search_shard(asked, graph.iloc[0], k), ignore_index=True)

    keys = ["dim", "shard", "block"]
    found = (
        queries.repartition(tasks, *keys).groupBy(*keys)
        .cogroup(copies.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(find, out)
    )
    return _ranked(found, k)


def _search_shard(asked: pd.DataFrame, graph: pd.Series, k: int) -> Iterator[pd.DataFrame]:
    dim = int(graph["dim"])
    vectors = np.frombuffer(graph["vectors"], np.float64).reshape(-1, dim)
    edges = np.frombuffer(graph["edges"], np.int32).reshape(len(vectors), -1)
    sizes = np.frombuffer(graph["members"], np.int32)
    ids, starts = np.frombuffer(graph["ids"], np.int64), np.concatenate([[0], np.cumsum(sizes)])
    base = _unit(vectors)
    for at in range(0, len(asked), BATCH):
        part = asked.iloc[at : at + BATCH]
        own, query = part["query_id"].to_numpy(), _dense(part["vector"])
        nodes, _ = beam_search(base, edges, int(graph["entry"]), _flat(query), min(int(graph["beam"]), len(base)))
        row, place = np.nonzero(nodes >= 0)
        node = nodes[row, place]
        score = (vectors[node] * query[row]).sum(axis=1)
        # Each node stands for all its copies.
        each = np.repeat(np.arange(len(node)), sizes[node])
        offset = np.arange(len(each)) - np.repeat(np.cumsum(sizes[node]) - sizes[node], sizes[node])
        vec = ids[starts[node[each]] + offset]
        row, score = row[each], score[each]
        other = vec != own[row]
        row, vec, score = row[other], vec[other], score[other]
        # A vec_id with several vectors counts by the nearest.
        order = np.lexsort((-score, vec, row))
        row, vec, score = row[order], vec[order], score[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (vec[1:] != vec[:-1])
        row, vec, score = row[first], vec[first], score[first]
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        top = rank < k
        yield pd.DataFrame({"query_id": own[row[top]], "vec_id": vec[top], "score": score[top]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # One shuffle by query serves both the grouping and the ranks.
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (
        once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
