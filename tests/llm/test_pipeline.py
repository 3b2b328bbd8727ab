import re

import corpus_pipeline
from ambilens.llm import pii, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_they_decide(spark, sf_docs, plain_docs):
    docs, seen = sf_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    texts = {d: t for d, t, *_ in plain_docs}
    with_letters = {d for d, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    assert {r.doc_id for r in seen["language_id"].collect()} == with_letters
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(seen["language_id"]).collect()}
    kept = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    assert set(kept) == {d for d, c in groups.items() if d == c} and len(kept) < len(groups)
    masked = {r.doc_id: r for r in seen["personal_data"].collect()}
    spans = {r.doc_id: r.pii_spans for r in pii.detect(seen["near_duplicates"]).collect()}
    assert set(masked) == set(kept)
    for d, r in masked.items():
        assert (r.text == kept[d]) == (not spans[d]) and r.n_chars == len(r.text)
        assert not re.search(r"[\w.]+@[\w]+\.example\.com", r.text)
    mixed = seen["mixing"].collect()
    assert {r.doc_id for r in mixed} <= set(masked) and all(r.text == masked[r.doc_id].text for r in mixed)
    starts = [r.doc_id for r in seen["packing"].collect() if r.start == 0]
    assert sorted(starts) == sorted(r.doc_id for r in mixed)


def test_odd_and_empty_inputs(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            before = rows.columns
            rows = corpus_pipeline.stage(stage(spark, rows, SF), name)
            assert name == "packing" or rows.columns == before
            if name == "near_duplicates" and docs is odd_docs:
                ids = sorted((r.doc_id for r in rows.collect() if r.doc_id is not None))
                assert ids == [1, 5, 7, 8]
        assert (rows.count() > 0) == (docs is odd_docs)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_rows_that_share_an_id_are_decided_one_by_one(spark):
    copy = "one text that is found under a smaller number as well, word for word " * 5
    alone = "quite another passage, about rivers and mountains, with no copy anywhere " * 5
    third = "zebra violin quantum marmalade lighthouse copper, unlike all of the others 12345 " * 5
    rows = [(1, copy), (2, copy), (2, alone), (3, third), (3, alone + third[::-1]), (4, "a single row; nothing like it"), (None, copy)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r != (2, copy)], key=str)
