"""Resharding with the fewest bytes moved: minimum-cost flow over shard sizes.

Documents lie in old shards of any size. Each old shard is cut into hash blocks; only
the block sizes reach the driver (old shards * BLOCKS rows at most). A minimum-cost flow
from old sizes to new capacities says how many bytes go from which shard to which;
whole blocks are then dealt to these amounts, largest first. Documents follow their
block by a broadcast lookup, so placing them moves no text. ``rewrite`` writes the
shards that gain or lose blocks and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ambilens.session import scratch_path, stage

SHARDS = 16
BLOCKS = 512
MAX_OLD_SHARDS = 1024


def min_cost_flow(
    supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]
) -> list[list[int]]:
    """Flow from sources to sinks that ships all supply at the least cost.

    Successive shortest paths in the residual graph: each round augments along the
    cheapest way from a source with supply left to a sink with room left.

    >>> min_cost_flow([5, 1], [3, 3], [[0, 1], [1, 0]])
    [[3, 2], [0, 1]]
    """
    if sum(supply) > sum(capacity):
        raise ValueError("The capacities are less than what there is")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    # Potentials keep reduced costs from being negative, so that Dijkstra applies.
    up, down = [0] * n, [0] * m
    while any(left):
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        heapify(heap)
        done = [False] * (n + m)
        while heap:
            d, v = heappop(heap)
            if done[v]:
                continue
            done[v] = True
            if v < n:
                steps = [(n + j, cost[v][j] + up[v] - down[j]) for j in range(m)]
            else:
                j = v - n
                steps = [(i, -cost[i][j] + down[j] - up[i]) for i in range(n) if flow[i][j]]
            for w, c in steps:
                if not done[w] and (far[w] is None or d + c < far[w]):
                    far[w], came[w] = d + c, v
                    heappush(heap, (d + c, w))
        reached = max(d for d in far if d is not None)
        for v in range(n + m):
            d = far[v] if far[v] is not None else reached
            if v < n:
                up[v] += d
            else:
                down[v - n] += d
        # The true cost of a way to sink j is its potential less that of where it begins.
        best = None
        for j in range(m):
            if room[j] and far[n + j] is not None:
                way, v = [], n + j
                while came[v] is not None:
                    way.append((came[v], v))
                    v = came[v]
                true = sum(cost[a][b - n] if a < n else -cost[b][a - n] for a, b in way)
                if best is None or true < best[0]:
                    best = true, way, v, j
        assert best is not None
        _, way, start, j = best
        amount = min([left[start], room[j], *(flow[b][a - n] for a, b in way if a >= n)])
        for a, b in way:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[start] -= amount
        room[j] -= amount
    return flow


@dataclass
class Plan:
    """Where each (old shard, block) goes, and the slot its first row gets there."""

    blocks: list[tuple[int, int, int, int]]  # old shard, block, shard, first slot
    moved_bytes: int
    affected: list[int]  # shards that gain or lose rows


def plan_moves(
    sizes: dict[tuple[int, int], tuple[int, int]], shards: int,
    cost: Sequence[Sequence[int]] | None = None,
) -> Plan:
    """Plan from (old shard, block) -> (bytes, rows); equal new capacities.

    Shard k of the new layout is shard k of the old one grown or shrunk, so by default
    a byte costs 0 to stay and 1 to move. ``cost`` may grade moves between shards.
    """
    old = sorted({o for o, _ in sizes})
    total = sum(b for b, _ in sizes.values())
    capacity = [total // shards + (k < total % shards) for k in range(shards)]
    supply = [sum(b for (o, _), (b, _) in sizes.items() if o == k) for k in old]
    price = cost or [[int(o != j) for j in range(shards)] for o in old]
    flow = min_cost_flow(supply, capacity, price)
    carry = [0] * shards
    target: dict[tuple[int, int], int] = {}
    for k, o in enumerate(old):
        # What blocks overshoot in one old shard is made up for in the next.
        need = [(-(flow[k][j] + carry[j]), j) for j in range(shards) if flow[k][j]]
        heapify(need)
        blocks = sorted(((b, block) for (s, block), (b, _) in sizes.items() if s == o), reverse=True)
        for b, block in blocks:
            room, j = heappop(need)
            target[o, block] = j
            heappush(need, (room + b, j))
        for room, j in need:
            carry[j] = -room
    first = [0] * shards
    placed, affected, moved = [], set(), 0
    for (o, block), j in sorted(target.items()):
        placed.append((o, block, j, first[j]))
        first[j] += sizes[o, block][1]
        if o != j:
            affected |= {o, j}
            moved += sizes[o, block][0]
    return Plan(placed, moved, sorted(affected))


def facts(docs: DataFrame, old_shard: Column, blocks: int = BLOCKS) -> DataFrame:
    return docs.select("doc_id", *measures(), old_shard.cast("int").alias("old_shard")).withColumn(
        "block", block_of(F.col("text_crc32"), blocks)
    )


def measures() -> list[Column]:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return [size.alias("size"), crc32_of("text").alias("text_crc32")]


def crc32_of(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def block_of(crc32: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), crc32), F.lit(blocks)).cast("int")


def reshard(
    docs: DataFrame, old_shard: Column, shards: int = SHARDS, blocks: int = BLOCKS
) -> tuple[DataFrame, Plan]:
    """``doc_id, size, text_crc32, old_shard, block, shard, slot`` of all rows, and the plan.

    Sizes are bytes of text plus 1, so that null and empty texts count. ``old_shard`` is a
    number from 0, not null, at most MAX_OLD_SHARDS different ones. Slots are gapless from
    0 in each shard: blocks in order, then doc_id. Repeated rows keep their number and
    take slots in a row. Other columns of ``docs`` are ignored; an empty table gives an
    empty one and an empty plan.
    """
    rows = stage(facts(docs, old_shard, blocks), "shard-facts")
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    found = sizes.limit(MAX_OLD_SHARDS * blocks + 1).collect()
    if len(found) > MAX_OLD_SHARDS * blocks:
        raise ValueError(f"More than {MAX_OLD_SHARDS} old shards")
    plan = plan_moves({(r.old_shard, r.block): (r.b, r.n) for r in found}, shards)
    table = docs.sparkSession.createDataFrame(
        plan.blocks, "old_shard int, block int, shard int, __first long"
    )
    order = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("__row", F.row_number().over(order))
        .join(F.broadcast(table), ["old_shard", "block"])  # at most MAX_OLD_SHARDS * blocks rows
        .withColumn("slot", F.col("__first") + F.col("__row") - 1)
        .drop("__first", "__row")
    ), plan


def rewrite(
    spark: SparkSession, old_path: str, new_path: str, plan: Plan, blocks: int = BLOCKS
) -> list[int]:
    """Write the affected shards of a table laid out as ``shard=<k>`` folders.

    Reads only affected shards of ``old_path`` and writes them below ``new_path``; the
    others stay as they are. Returns the shards that were written.
    """
    if not plan.affected:
        return []
    old = spark.read.parquet(old_path)
    columns = [c for c in old.columns if c != "shard"]
    keyed = old.where(F.col("shard").isin(plan.affected)).withColumn("__block", block_of(crc32_of("text"), blocks))
    table = spark.createDataFrame(
        [(o, b, j) for o, b, j, _ in plan.blocks], "shard int, __block int, __to int"
    )
    moved = keyed.join(F.broadcast(table), ["shard", "__block"])
    moved.select(*columns, F.col("__to").alias("shard")).write.partitionBy("shard").parquet(new_path)
    return plan.affected


def reshard_files(
    docs: DataFrame, old_shard: Column, shards: int = SHARDS, blocks: int = BLOCKS
) -> tuple[DataFrame, Plan]:
    """``doc_id, size, text_crc32, shard, slot, old_shard`` as the files say after :func:`rewrite`.

    ``docs`` (doc_id, text) are laid out in their old shards, planned from there, and the
    affected shards rewritten; then all shards are read back from where they lie now.
    Otherwise like :func:`reshard`.
    """
    spark = docs.sparkSession
    old_path, new_path = scratch_path(spark, "shards-old"), scratch_path(spark, "shards-new")
    number = old_shard.cast("int")
    laid = docs.select("doc_id", "text", number.alias("old_shard"), number.alias("shard"))
    laid.write.option("compression", "zstd").partitionBy("shard").parquet(old_path)
    old = spark.read.schema(laid.schema).parquet(old_path)
    _, plan = reshard(old, F.col("shard"), shards, blocks)
    written = rewrite(spark, old_path, new_path, plan, blocks)
    now = old.where(~F.col("shard").isin(written))
    if written:
        now = now.unionByName(spark.read.schema(laid.schema).parquet(new_path))
    return slots(now, blocks, ["old_shard"]), plan


def slots(placed: DataFrame, blocks: int = BLOCKS, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of rows with ``doc_id, text, shard``; ``keep`` too.

    Slots are gapless from 0 in each shard: by hash block, then doc_id.
    """
    known = placed.select("doc_id", *measures(), "shard", *keep)
    rows = stage(known.withColumn("block", block_of(F.col("text_crc32"), blocks)), "shard-slots")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select(  # shards * blocks rows
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first")
    )
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(first), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__first") + F.row_number().over(order) - 1).alias("slot"), *keep
    )
