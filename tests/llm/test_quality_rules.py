import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ambilens.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_measures_like_plain_python(spark, sf_docs, plain_docs):
    found = {r.doc_id: tuple(r)[1:] for r in rules.measure(sf_docs).select("doc_id", *rules.COUNTS, "base_failed").collect()}
    assert found == {d: plain(t) for d, t, *_ in plain_docs}


def test_windows_of_many_texts():
    rng = np.random.default_rng(3)
    for vocabulary in (1, 2, 3, 9):
        texts = [" ".join(map(str, rng.integers(0, vocabulary, n))) for n in (0, 1, 7, 8, 9, 16, 30, 0, 200)]
        counts, _ = rules.measures([t.encode() for t in texts])
        assert counts[:, 4].tolist() == [plain(t)[4] for t in texts]


def test_allowed_errors_are_the_exact_bound():
    for n in (1, 40, 300, 2000):
        for limit, error in ((0.05, 0.05), (0.0055, 0.0014), (0.3, 0.01)):
            below = np.cumsum([math.comb(n, k) * limit**k * (1 - limit) ** (n - k) for k in range(min(n, 700) + 1)] if n <= 300 else
                              np.exp([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(limit) + (n - k) * math.log1p(-limit) for k in range(n + 1)]))
            want = max((k for k, p in enumerate(below) if p <= error), default=-1)
            assert rules.allowed_errors(n, limit, error) == want
    assert 0 < rules.allowed_errors(10**12, 0.01, 1e-4) < 10**10


def test_choice_is_certified_and_useful():
    extent = np.arange(0, 1001, 100)
    good, bad = np.array([5000, 900, 60, 3, 0, 1, 0, 0, 0, 0, 0]), np.array([0, 1, 0, 0, 9, 9, 20, 0, 0, 0, 0])
    assert rules.choose(extent, good, bad, 0.005, 0.01)[0] == 400
    assert good[4:].sum() <= rules.allowed_errors(good.sum(), 0.005, 0.01) < good[3:].sum() + 50
    # Too few good documents, or none bad: the rule stays off.
    assert rules.choose(extent, good // 100, bad, 0.005, 0.01)[0] == rules.STEPS + 1
    assert rules.choose(extent, good, bad * 0, 0.005, 0.01)[0] == rules.STEPS + 1


def test_false_rejections_stay_under_the_limit():
    """The guarantee, simulated: good documents drawn from a law whose loss at each cutoff is known."""
    rng, broken, tried = np.random.default_rng(5), 0, 400
    limit, error = 0.05, 0.1
    for _ in range(tried):
        good = np.bincount(np.minimum(rng.geometric(0.01, 600), 1000), minlength=1001)
        bad = np.bincount(rng.integers(0, 1001, 300), minlength=1001)
        cutoff = rules.choose(np.arange(1001), good, bad, limit, error)[0]
        broken += (0.99 ** (cutoff - 1) if cutoff <= 1000 else 0) > limit
    assert broken / tried <= error + 3 * math.sqrt(error * (1 - error) / tried)


def labelled(spark, n, junk):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % junk == 0
        text = " ".join(rng.choice(words, 60)) + (" ### $$$ %%% " * 5 if bad else "")
        rows.append((i, text, "en" if i % 2 else None))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = labelled(spark, 6001, 7)
    found = rules.judge_documents(docs, labels).collect()
    assert all(not r.kept for r in found if r.doc_id % 7 == 0)
    lost = [r for r in found if not r.kept and r.doc_id % 7]
    assert not lost  # other rules that lose a few good ones for the same bad ones are off
    assert {r.failed_rules for r in found if r.kept} == {""}


def test_copies_count_once(spark):
    docs, labels = labelled(spark, 40, 7)
    many = docs.crossJoin(spark.range(300).select(F.col("id").alias("n"))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("n"))
    each = many.join(labels.withColumnRenamed("doc_id", "of"), F.col("of") == F.col("doc_id") % 1000)
    found = rules.judge_documents(many.select("doc_id", "text", "lang"), each.select("doc_id", "quality"))
    assert found.where("kept").count() == 12000  # 40 texts certify nothing


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (1, None), (None, 1), (99, 1), (5, 0)], "doc_id long, quality int"
    )
    found = rules.judge_documents(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    for row in odd_docs.select("doc_id", "text").collect():
        want = plain(row.text)
        got = [r for r in found if r.doc_id == row.doc_id]
        assert any((*[r[c] for c in rules.COUNTS], r.base_failed) == want for r in got)
    assert all(r.kept != r.base_failed for r in found)
    assert rules.judge_documents(no_docs, labels).count() == 0
    assert rules.judge_documents(no_docs, labels.where("false")).count() == 0
