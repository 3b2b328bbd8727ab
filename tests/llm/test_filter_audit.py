import re
from collections import Counter
from itertools import permutations

import numpy as np

from ambilens.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (doc_id, text, lang); every order applied to every document, one by one."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    out = Counter()
    parts = {lang or "" for *_, lang in docs}
    for d, text, lang in docs:
        text, part = text or "", lang or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and first[text] < d,
        }
        for letter in "ABCDE":
            if [x for x in fails if fails[x]] == [letter]:
                out[part, letter, "unique_fails"] += 1
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                at = part, "".join(order), step
                if fails[letter] and gone:
                    out[*at, "redundant"] += 1
                elif fails[letter]:
                    gone = True
                    out[*at, "removed"] += 1
                    out[part, letter, "shapley"] += 1
                    out[*at, "good_lost"] += d in good
                    out[*at, "toxic_lost"] += d in toxic
                out[*at, "kept"] += not gone
    return {
        (part, "".join(order), step): tuple(
            out[(part, letter, c) if c in ("unique_fails", "shapley") else (part, "".join(order), step, c)]
            for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
        )
        for part in parts for order in permutations("ABCDE") for step, letter in enumerate(order, 1)
    }


def as_dict(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_documents_like_one_by_one(spark, sf_docs, plain_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = plain([(d, t, lang) for d, t, lang, _ in plain_docs], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert as_dict(filter_audit.audit_filters(sf_docs, labels)) == want


def test_copies_over_parts_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    texts = ["a b", "A", "x " * 120, " ".join(map(str, range(120))), "", None, "# " + " ".join(map(str, range(120)))]
    docs = [
        (int(i) if i else None, texts[rng.integers(len(texts))], [None, "", "en", "fr"][rng.integers(4)])
        for i in rng.integers(0, 60, 300)
    ]
    labels = [(int(i) if i else None, [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for i in rng.integers(0, 80, 90)]
    made = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    found = filter_audit.audit_filters(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert as_dict(found) == plain(docs, labels)


def test_fields_do_not_overflow():
    counts = {mask: (1 << 50) + mask for mask in range(128)}
    many, one = filter_audit.audit(counts), [filter_audit.audit({mask: 1}) for mask in counts]
    for column in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
        want = sum(rows[column].to_numpy(object) * n for rows, n in zip(one, counts.values()))
        assert many[column].tolist() == want.tolist()


def test_a_mask_is_one_integer():
    fields = filter_audit.unpacked(filter_audit.packed(filter_audit.bit("C") | filter_audit.GOOD))
    at = filter_audit.ORDERS.index("BACED")
    assert fields[at, :, filter_audit.OUTCOMES.index("removed")].tolist() == [0, 0, 1, 0, 0]
    assert fields[at, :, filter_audit.OUTCOMES.index("kept")].tolist() == [1, 1, 0, 0, 0]
    assert fields[at, :, filter_audit.OUTCOMES.index("good_lost")].tolist() == [0, 0, 1, 0, 0]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    plain_rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    want = plain(plain_rows, [tuple(r) for r in labels.collect()])
    assert as_dict(filter_audit.audit_filters(odd_docs, labels)) == want
    assert filter_audit.audit_filters(no_docs, labels).count() == 0
    assert as_dict(filter_audit.audit_filters(odd_docs, labels.where("false"))).keys() == want.keys()
