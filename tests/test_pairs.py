"""Pairing, deduplication, ordinals and skew-safe joins against brute force."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ambilens.operators import ordinals, pairs, skew, unique
from ambilens.operators.checks import InvalidInput

SCHEMA = "source_index bigint, source_text string, ambiguity tinyint, processed_text string"


def hot_texts(n=150, seed=1):
    """One source with a third of all rows."""
    rng = random.Random(seed)
    rows = {(0, f"hot {i}") for i in range(n // 3)}
    while len(rows) < n:
        rows.add((rng.randrange(1, 12), rng.choice("abcdefgh") * rng.randint(1, 9) + "é\"\n"[rng.randrange(3)]))
    return [(s, f"s{s}", s % 2, t) for s, t in sorted(rows)]


def expected(rows):
    groups = defaultdict(list)
    for s, _, _, t in rows:
        groups[s].append(t)
    return sorted((s, a, b) for s, ts in groups.items() for a, b in itertools.combinations(sorted(ts), 2))


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_every_pair_once(spark, block):
    rows = hot_texts()
    df = spark.createDataFrame([*rows, (None, "x", 0, "p"), (None, "x", 0, "q")], SCHEMA)
    got = pairs.translation_pairs(df, block).collect()
    assert sorted((r.source_index, r.sentence1, r.sentence2) for r in got) == expected(rows)
    assert {(r.source_text, r.ambiguity) for r in got if r.source_index == 3} == {("s3", 1)}
    assert pairs.pair_estimate(df).first().n_pairs == len(got)
    assert pairs.plan_pairs(df, block).pairs == len(got)


def test_a_hot_source_is_many_units(spark):
    rows = hot_texts(300)
    df = spark.createDataFrame(rows, SCHEMA)
    placed = pairs._blocked(df, 10)
    sizes = placed.where("source_index = 0").groupBy("__own").count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) <= 30
    plan = pairs.translation_pairs(df, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_pair_join_reuses_its_partitioning(spark):
    df = spark.createDataFrame(hot_texts(), SCHEMA)
    for block in (5, 1000):
        plan = pairs.translation_pairs(df, block, partitions=6)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 2
        joined = plan[: plan.index("REPARTITION_BY_NUM")]
        assert "ENSURE_REQUIREMENTS" not in joined


@pytest.mark.parametrize("partitions", [1, 2, 3, 9, None])
def test_ordered_pairs_are_not_shuffled(spark, partitions):
    """Every pair once, in order over all partitions; only texts are exchanged."""
    rows = hot_texts(300)
    df = spark.createDataFrame([*rows, (None, "x", 0, "p"), (1, "s1", 1, None)], SCHEMA).withColumn("n", F.length("processed_text"))
    found = pairs.translation_pairs(df, 10, partitions, ordered=True, carry=["n"])
    got = found.withColumn("at", F.spark_partition_id()).collect()
    assert [(r.source_index, r.sentence1, r.sentence2) for r in got] == expected(rows)
    assert all((r.n1, r.n2, r.source_text) == (len(r.sentence1), len(r.sentence2), f"s{r.source_index}") for r in got)
    assert len({r["at"] for r in got}) > 4 * (partitions == 9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_pairs_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pairs.translation_pairs(empty).count() == 0
    assert pairs.translation_pairs(empty, ordered=True).count() == 0
    assert pairs.pair_estimate(empty).first().n_pairs == 0
    lone = spark.createDataFrame([(1, "s", 0, "a"), (2, "t", 0, "a")], SCHEMA)
    assert pairs.translation_pairs(lone).count() == 0


@pytest.mark.parametrize("block", [4, 1000])
def test_source_groups(spark, block):
    rows = hot_texts()
    groups = defaultdict(list)
    for row in pairs.source_groups(spark.createDataFrame(rows, SCHEMA), block).collect():
        assert len(row.texts) <= block and row.source_text == f"s{row.source_index}"
        groups[row.source_index].append((row.block_index, row.texts))
    for source, blocks in groups.items():
        joined = [t for _, texts in sorted(blocks) for t in texts]
        assert joined == sorted(t for s, _, _, t in rows if s == source)


def test_unique_translations(spark, rows):
    data = [(1, "s", 0, "b"), (1, "s", 0, "b"), (1, "s", 0, "a"), (1, "s", 0, " 　"), (1, "s", 0, None),
            (2, "t", None, "a"), (None, "u", 0, "z"), (None, "v", 1, "z")]
    df = spark.createDataFrame(data, SCHEMA)
    table = unique.aggregate_candidates(df)
    got = [(r.source_index, r.processed_text) for r in table.collect()]
    assert got == [(1, "a"), (1, "b"), (2, "a"), (None, "z")]
    assert unique.excluded_empties(df).first() == (8, 2)
    assert rows(unique.unique_translations(table), "source_index", "processed_text") == rows(
        table, "source_index", "processed_text")
    with pytest.raises(InvalidInput):
        unique.aggregate_candidates(df.union(spark.createDataFrame([(2, "w", None, None)], SCHEMA)))


def test_with_ordinal(spark):
    keys = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(k, f"k{k}") for k in keys], "k bigint, name string").repartition(7)
    got = sorted((r.n, r.k, r.name) for r in ordinals.with_ordinal(df, ["k"], "n").collect())
    assert got == [(n, k, f"k{k}") for n, k in enumerate(sorted(keys))]


def test_group_ordinal(spark):
    rows = hot_texts(200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ordinals.group_ordinal(df, "source_index", ["processed_text"], "n")
    groups = defaultdict(list)
    for s, _, _, t in rows:
        groups[s].append(t)
    want = {(s, t): n for s, ts in groups.items() for n, t in enumerate(sorted(ts))}
    assert {(r.source_index, r.processed_text): r.n for r in got.collect()} == want


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_is_the_same_either_way(spark, rows, how):
    facts = spark.range(300).select(
        F.when(F.col("id") < 100, 7).otherwise(F.col("id") % 13).alias("k"), "id")
    lookup = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows(facts.join(lookup, "k", how))
    assert rows(skew.lookup_join(facts, lookup, ["k"], how)) == plain
    salted = skew.lookup_join(facts, lookup, ["k"], how, max_rows=3, salts=5)
    assert rows(salted) == plain
    near = F.col("id") > F.col("v") * 10
    assert rows(skew.lookup_join(facts, lookup, ["k"], how, condition=near)) == rows(
        skew.lookup_join(facts, lookup, ["k"], how, condition=near, max_rows=3, salts=5))


def test_broadcast_bound(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2])] * 20, "t string, a array<int>")
    assert skew.fits_broadcast(df)
    assert not skew.fits_broadcast(df, max_rows=19)
    assert not skew.fits_broadcast(df, max_bytes=20_000)


def test_copies_of_a_text_are_bounded(spark, monkeypatch):
    """A source that grows gets larger blocks, not more, until those are full."""
    df = spark.createDataFrame(hot_texts(600), SCHEMA)
    copies = [pairs._blocked(df, block).agg(F.max("__blocks")).first()[0] for block in (10, 2, 1)]
    assert copies == [20, pairs.MAX_BLOCKS, pairs.MAX_BLOCKS]
    monkeypatch.setattr(pairs, "LARGEST_BLOCK", 4)
    assert pairs._blocked(df, 2).agg(F.max("__blocks")).first()[0] == 50
    got = pairs.translation_pairs(df, 2).collect()
    assert sorted((r.source_index, r.sentence1, r.sentence2) for r in got) == expected(hot_texts(600))
    assert pairs.plan_pairs(df, 1000).units == pairs.plan_pairs(df, 1000).sources


def test_wanted_keys_meet_the_cache_where_they_are_grouped(spark):
    """One exchange on either side: keys that were made distinct don't move again for the join."""
    from ambilens.operators.scoring import wanted_keys

    place = "source_index int, one struct<a:long,b:int>, two struct<a:long,b:int>"
    rows = [(b"\x04", 1, 2, (1, 1), (2, 2)), (b"\x04", 1, 1, (1, 1), (2, 2)), (b"\x08", 2, 1, (1, 1), (3, 3))]
    wanted = wanted_keys(spark.createDataFrame(rows, f"key binary, bucket int, {place}"))
    held = spark.createDataFrame([(b"\x08",)], "key binary")
    absent = wanted.join(held.hint("merge"), "key", "left_anti")
    plan = absent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert [(bytes(r.key), r.bucket, r.source_index) for r in absent.collect()] == [(b"\x04", 1, 1)]
