import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ambilens.llm import pitman_yor
from ambilens.llm.common import crc32_mod


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(doc):
    return doc is not None and crc32(str(doc).encode()) % 5 == 1


def check_base(rows, found):
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(
        (str(d), held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)),
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5))
        for d, t in rows
    )
    got = sorted((str(r.doc_id) if r.doc_id is not None else "None", r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4] for g in got], [w[4] for w in wanted], rtol=1e-6, atol=1e-4)
    assert all(r.train_tokens == n for r in found)


@pytest.mark.parametrize("tokens_per_shard", [10_000_000, 5_000])
def test_scores(sf_docs, plain_docs, tokens_per_shard):
    found = pitman_yor.score_documents(sf_docs, crc32_mod("doc_id", 5) == 1, tokens_per_shard).collect()
    check_base([(d, t) for d, t, *_ in plain_docs], found)
    out = [r for r in found if r.held_out]
    n = sum(r.n_tokens for r in out)
    perplexity = 10 ** (-sum(r.score for r in out) / n)
    assert perplexity < 0.6 * 10 ** (-sum(r.base_score for r in out) / n)
    assert all(r.score < 0 for r in found)


def test_odd_rows(spark, odd_docs, no_docs):
    found = pitman_yor.score_documents(odd_docs, crc32_mod("doc_id", 5) == 1).collect()
    check_base([(r.doc_id, r.text) for r in odd_docs.collect()], found)
    assert pitman_yor.score_documents(no_docs, crc32_mod("doc_id", 5) == 1).count() == 0
    one = spark.createDataFrame([(4, "a b"), (6, None)], "doc_id long, text string")
    assert [held(4), held(6)].count(True) < 2
    none = pitman_yor.score_documents(one, crc32_mod("doc_id", 5) >= 0).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.held_out for r in none)


def a_chain(counts, contexts=40, seed=0):
    """counts: {(word, context): n}; a chain over one shard with its own totals."""
    keys = sorted(counts)
    words = sorted({w for w, _ in keys})
    row = {
        "shard": seed, "words": np.array(words, np.uint64).tobytes(),
        "types": np.array([sum(w == x for w, _ in keys) for x in words], np.uint32).tobytes(),
        "contexts": np.array([c for _, c in keys], np.uint16).tobytes(),
        "counts": np.array([counts[k] for k in keys], np.uint32).tobytes(),
    }
    customers, tables = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (_, c), n in counts.items():
        customers[c] += n
        tables[c] += 1
    totals = pitman_yor.Totals(customers, tables, sum(counts.values()), len(words), len(keys), len(words), 0.6, 0.4, {})
    return pitman_yor.Chain(row, totals), keys


def test_seating_invariants():
    rng = np.random.default_rng(1)
    counts = {(int(w), int(c)): int(n) for w, c, n in zip(rng.integers(1, 30, 300), rng.integers(0, 20, 300), rng.zipf(1.5, 300) % 900 + 1)}
    chain, keys = a_chain(counts)
    for _ in chain.run(3, 5):
        assert ((chain.t >= 1) & (chain.t <= chain.count)).all()
        assert (chain.root_c == np.bincount(chain.dish, chain.t)).all()
        assert ((chain.root_t >= 1) & (chain.root_t <= chain.root_c)).all()
        p = chain.probability()
        assert ((p > 0) & (p < 1)).all()


def test_tables_keep_customers_and_match_the_exact_law():
    """Number of tables for one dish of c customers at constant opening weight a: Gibbs
    moves leave P(t) proportional to a^t S(c, t), the sum over partitions of the product
    of (1-d)(2-d)...(size-1-d)."""
    c, a, d = 6, 0.8, 0.5
    law = np.zeros(c + 1)

    def split(rest, sizes):
        if not rest:
            law[len(sizes)] += a ** len(sizes) * math.prod(math.gamma(s - d) / math.gamma(1 - d) for s in sizes)
            return
        first, others = rest[0], rest[1:]
        for mask in range(1 << len(others)):
            block = [first] + [x for i, x in enumerate(others) if mask >> i & 1]
            split([x for x in others if x not in block], [*sizes, len(block)])

    split(list(range(c)), [])
    law /= law.sum()
    lanes = 20_000
    tables = pitman_yor.Tables(lanes, d, np.random.default_rng(7))
    tables.fill(np.full(lanes, c), np.full(lanes, a))
    every, opening = np.arange(lanes), np.full(lanes, a)
    for _ in range(25):
        tables.move(every, opening)
        assert tables.size.sum() == lanes * c
    seen = np.bincount(tables.tables(), minlength=c + 1) / lanes
    assert np.abs(seen - law).max() < 0.015


def test_large_dishes_are_filled_in_blocks():
    tables = pitman_yor.Tables(3, 0.7, np.random.default_rng(3))
    tables.fill(np.array([1, 5000, 40]), np.array([1.0, 2.0, 3.0]))
    assert np.add.reduceat(tables.size, tables.first).tolist() == [1, 5000, 40]
    assert (tables.size[tables.last] == 0).all() and tables.tables()[1] > 20


def test_split_words_keep_their_totals():
    layout = pitman_yor.Layout(7, {5: 4})
    words = np.array([5, 9], np.uint64)
    contexts = np.arange(0, 1 << 16, 97, dtype=np.uint16)
    where = layout.shard_of(words, contexts, np.zeros(len(contexts), np.int64))
    assert 1 < len(set(where.tolist())) <= 4
    assert len(set(layout.shard_of(words, contexts, np.ones(len(contexts), np.int64)).tolist())) == 1


def test_every_word_has_its_own_restaurant(spark):
    """More words than any 16-bit number: a rare word keeps what followed it, and only that."""
    words = [f"w{k}" for k in range(70_000)]
    rows = [(k, " ".join(words[k : k + 1000])) for k in range(0, len(words), 1000)]
    rows += [(10**6 + k, "often then " * 300) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    layout = pitman_yor.plan_layout(docs, 40_000)
    state = pitman_yor.gather(pitman_yor.deal(docs, F.lit(False), layout), layout.shards)
    seated = state.where("words is not null")
    merged, found = pitman_yor._sums(seated, None, frozenset(layout.splits), 3)
    counts = Counter()
    for d, t in rows:
        counts.update([b"\n", *t.encode().split()])
    got = {}
    for row in pitman_yor._joined(seated, merged).collect():
        own = pitman_yor._own_totals(row.asDict(), pitman_yor._totals(found, None), 3)
        got |= dict(zip(np.frombuffer(row["restaurants"], np.uint64).tolist(), own.customers.tolist()))
    assert got == {xxhash.xxh64_intdigest(w, 0): n for w, n in counts.items()}


def test_a_step_reseats_every_customer():
    """Each draw follows the law of the number of tables, however many customers a dish has."""
    a, d, lanes = 0.8, 0.5, 20_000
    every = np.arange(lanes)
    tables = pitman_yor.Tables(lanes, d, np.random.default_rng(2))
    tables.fill(np.full(lanes, 6), np.full(lanes, a))
    for _ in range(25):
        tables.move(every, np.full(lanes, a))
    drawn = pitman_yor.draw_tables(np.full(lanes, 6), np.full(lanes, a), d, np.random.default_rng(1))
    seen = [np.bincount(x, minlength=7) / lanes for x in (drawn, tables.tables())]
    assert np.abs(seen[0] - seen[1]).max() < 0.02
    most = 2500
    for d, a in ((0.7, 20.0), (0.8, 0.5), (0.5, 0.01), (0.6, 400.0), (0.3, 30_000.0)):
        weight = pitman_yor._seatings(d, most)[most] + np.log(a) * np.arange(1, most + 1)
        law = np.exp(weight - weight.max())
        law /= law.sum()
        mean = law @ np.arange(1, most + 1)
        spread = math.sqrt(law @ (np.arange(1, most + 1) - mean) ** 2)
        n = 20_000
        drawn = pitman_yor.draw_tables(np.full(n, most), np.full(n, a), d, np.random.default_rng(3))
        assert abs(drawn.mean() - mean) < 0.05 * spread and 0.95 < (drawn.std() + 1e-3) / (spread + 1e-3) < 1.05


def test_steps_reseat_frequent_pairs():
    """A chain's samples of one frequent pair scatter as the law says; the seating isn't kept."""
    chain, _ = a_chain({(1, 3): 50_000, (2, 3): 50_000})
    seen = []
    for _ in chain.run(8, 200):
        seen.append(chain.t.tolist())
    seen = np.array(seen, float)
    assert (np.corrcoef(seen[:-1, 0], seen[1:, 0])[0, 1] < 0.5) and seen[:, 0].std() > 0.5


def test_rounds_that_pass_totals_on_burn_in(spark, sf_docs, monkeypatch):
    runs = []
    run = pitman_yor.Chain.run
    monkeypatch.setattr(pitman_yor.Chain, "run", lambda self, *a: runs.append(a) or run(self, *a))

    class Here:
        """mapInPandas in this process, so that the calls are seen."""

        def __init__(self, rows):
            self.rows = rows

        def select(self, *_):
            return self

        def mapInPandas(self, f, _):  # noqa: N802
            list(f(iter([self.rows])))
            raise StopIteration

    layout = pitman_yor.plan_layout(sf_docs)
    seated = pitman_yor.gather(pitman_yor.deal(sf_docs, F.lit(False), layout), 1).where("words is not null")
    merged, found = pitman_yor._sums(seated, None, frozenset(), 1)
    joined = pitman_yor._joined(seated.select(*pitman_yor._LIGHT), merged).toPandas()
    with pytest.raises(StopIteration):
        pitman_yor._sums(Here(joined), pitman_yor._totals(found, None), frozenset(), 1)
    assert runs == [(pitman_yor.BURN_IN, 1)]


def test_base_score_in_double_precision(spark):
    rows = [(0, "a b c d e " * 40_000), (1, "a b f g " * 1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.base_score for r in pitman_yor.score_documents(docs, F.lit(False), 50_000).collect()}
    counts = Counter(w for _, t in rows for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        exact = math.fsum(k * math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w, k in Counter(tokens(t)).items())
        assert abs(found[d] / exact - 1) < 1e-11


def test_tables_of_earlier_rounds_are_deleted(spark, sf_docs):
    """On disk stay the state and the last round's totals, packed; what led to them is gone."""
    from pathlib import Path

    from ambilens.session import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    before = {p.name for p in root.iterdir()}
    found = pitman_yor.score_documents(sf_docs, crc32_mod("doc_id", 5) == 1, 20_000)
    assert found.count() == sf_docs.count()
    new = [p.name.rpartition("-")[0] for p in root.iterdir() if p.name not in before]
    assert sorted(new) == ["lm-sample", "lm-state", "lm-totals"]


def test_packed_numbers_come_back():
    for kind in (np.uint16, np.uint32):
        for values in ([], [7], [3, 3, 9, 2, 65_535, 0]):
            numbers = np.array(values, kind)
            packed = pitman_yor._packed(pitman_yor._steps(numbers))
            assert pitman_yor._summed(pitman_yor._unpacked(packed, kind)).tolist() == values
    many = np.arange(100_000, dtype=np.uint32)
    assert len(pitman_yor._packed(pitman_yor._steps(many))) < 1_000
