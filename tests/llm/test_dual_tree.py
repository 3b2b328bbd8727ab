import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambilens.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text); every pair scored."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall((text or "").translate(LOW)))
    out = []
    for i, item in asked.items():
        found = []
        for d, bag in bags:
            m = 100 - 75 + 75 * bag.total() * n // length
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t, c in item.items() if t in bag
            )
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_benchmark_like_brute_force(spark, sf_docs, plain_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = dual_tree.rank_documents(sf_docs, items)
    assert sorted(map(tuple, found.collect())) == plain([(d, t) for d, t, *_ in plain_docs], [tuple(r) for r in items.select("item_id", "text").collect()])


@pytest.mark.parametrize("tree_bytes, item_bytes", [(200, 1 << 20), (1 << 20, 1 << 20), (2000, 400)])
def test_any_pieces_and_blocks(spark, monkeypatch, tree_bytes, item_bytes):
    monkeypatch.setattr(dual_tree, "TREE_BYTES", tree_bytes)
    monkeypatch.setattr(dual_tree, "ITEM_BYTES", item_bytes)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(60, 0, -1) / 1830))
    docs = [(int(d), text(rng.integers(0, 30))) for d in rng.permutation(500)]
    docs += [(d + 1000, t) for d, t in docs[:200]]  # equal scores
    items = [(i, text(rng.integers(0, 8))) for i in range(45)]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = dual_tree.rank_documents(made, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, found.collect())) == plain(docs, items, 7)


def test_batches_are_pruned_and_results_exact():
    """Documents of 40 topics, items of one each: most pairs are never scored."""
    rng = np.random.default_rng(10)
    topic = [[f"t{t}x{i}" for i in range(30)] for t in range(40)]
    common = [f"c{i}" for i in range(20)]
    docs = [(d, " ".join([*rng.choice(topic[rng.integers(40)], 20), *rng.choice(common, 5)])) for d in range(4000)]
    items = [(i, " ".join([*rng.choice(topic[i % 40], 8), *rng.choice(common, 2)])) for i in range(80)]
    bags = {i: Counter(dual_tree.terms_of(t.encode())) for i, t in items}
    vocabulary = {t: n for n, t in enumerate(sorted({t for b in bags.values() for t in b}))}
    counts = [Counter(dual_tree.terms_of(t.encode())) for _, t in docs]
    held = np.array([sum(t in c for c in counts) for t in vocabulary])
    made = dual_tree.prepare(bags, vocabulary, held, len(docs), sum(c.total() for c in counts))
    search = dual_tree.Search(made)
    own = [sorted((vocabulary[t], n) for t, n in c.items() if t in vocabulary) for c in counts]
    sizes = np.array([len(x) for x in own])
    term, times = (np.array([e[at] for x in own for e in x]) for at in (0, 1))
    impact = made.impacts(np.array([c.total() for c in counts]), times, sizes)
    search.add(np.arange(len(docs)), dual_tree.Tree(sizes, term, impact, made.weight))
    assert search.scored < 0.25 * len(docs) * len(items)
    rows = sorted(zip(*(c.to_pylist() for c in search.found().columns)))
    assert rows == sorted((i, d, s) for i, _, d, s in plain(docs, items))


def test_maxima_bound_every_leaf_below():
    rng = np.random.default_rng(11)
    sizes = rng.integers(1, 9, 300)
    term = np.concatenate([rng.choice(50, s, replace=False) for s in sizes])
    value = rng.integers(1, 1000, len(term))
    tree = dual_tree.Tree(sizes, term, value, np.ones(50, np.int64))
    dense = []
    for level in tree.levels:
        rows = np.zeros((len(level), 50), np.int64)
        for node in range(len(level)):
            rows[node, level.term[level.row(node)]] = level.value[level.row(node)]
        dense.append(rows)
    for above, below in zip(dense[1:], dense):
        for node in range(len(above)):
            assert (above[node] == below[node * dual_tree.FAN : (node + 1) * dual_tree.FAN].max(axis=0)).all()
    assert len(dense[-1]) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(1, "brown Fox"), (1, "fox"), (2, None), (3, ""), (None, "fox"), (4, "ÉTÉ été là"), (5, "alpha " * 9), (6, "!!!")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("rank", F.lit("x"))
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, dual_tree.rank_documents(odd_docs, items).collect())) == plain(docs, rows)
    assert dual_tree.rank_documents(no_docs, items).count() == 0
    assert dual_tree.rank_documents(odd_docs, items.where("false")).count() == 0
    assert dual_tree.rank_documents(odd_docs.where("text is null"), items).count() == 0
