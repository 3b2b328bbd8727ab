from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ambilens.llm import language, packing
from ambilens.llm.common import crc32_mod, rank_within
from ambilens.llm.queries import op1_language_id


def test_grams_stay_in_their_text():
    buckets, owner, letters = language.grams(["ab", "", "1 2", "Ba"])
    one = [language.grams([t]) for t in ("ab", "", "1 2", "Ba")]
    for k, (b, _, n) in enumerate(one):
        assert sorted(buckets[owner == k]) == sorted(b) and letters[k] == n[0]
    assert letters.tolist() == [2, 0, 0, 2]
    # "ab": a, b; _a, ab, b_; _ab, ab_
    assert (owner == 0).sum() == 7


def test_counts_do_not_depend_on_the_slices():
    rng = np.random.default_rng(13)
    texts = ["".join(rng.choice(list("abé 1.\n😀"), n)) for n in (0, 1, 2, 5, 40, 300, 0, 7, 90)] + ["." * 50, "x" * 50, "a..........b"]
    want = [Counter(language.grams([t])[0].tolist()) for t in texts]
    for limit in (1, 2, 3, 7, 50, 1000):
        found, letters = [Counter() for _ in texts], np.zeros(len(texts))
        for buckets, owner, letters_found in language.blocks(texts, limit):
            for bucket, text in zip(buckets.tolist(), owner.tolist()):
                found[text][bucket] += 1
            letters += letters_found
        assert found == want and letters.tolist() == [sum(map(str.isalpha, t)) for t in texts], limit


def test_held_out_accuracy(spark):
    found = op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(langs, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert len(found) == len(langs) and (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: crc32(str(i).encode()) % 3 == 1)).all()


def test_scores_equal_plain_naive_bayes(spark, plain_docs):
    rows = [(t, lang) for _, t, lang, _ in plain_docs if lang][:60]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    counts = {lang: np.full(language.BUCKETS, language.SMOOTHING) for _, lang in rows}
    for text, lang in rows:
        for bucket in language.grams([text])[0]:
            counts[lang][bucket] += 1
    assert model.langs == sorted(counts)
    for text, _ in rows[:10]:
        buckets = language.grams([text])[0]
        plain = {k: np.log(c / c.sum())[buckets].sum() for k, c in counts.items()}
        best, share = model.score([text])
        assert model.langs[best[0]] == max(plain, key=plain.get) and 0 < share[0] <= 1


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language.train(odd_docs.select("text", "lang"))
    rows = language.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].lang_pred == by_id[3].lang_pred == by_id[6].lang_pred == "und" and by_id[2].score == 0
    assert by_id[7].lang_pred == "fr" and by_id[5].lang_pred == "en"
    assert language.predict(no_docs, model).count() == 0
    empty = language.train(no_docs.select("text", "lang"))
    assert {r.lang_pred for r in language.predict(odd_docs, empty).collect()} == {"und"}


def brute_packs(histogram, size):
    """One piece at a time into the pack with the most room, longest first."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [p for p in packs if size - sum(p) >= length]
            if fits:
                max(fits, key=lambda p: size - sum(p)).append(length)
            else:
                packs.append([length])
    return packs


def test_shortest_pack_first_like_one_by_one():
    rng = np.random.default_rng(1)
    for size in (10, 64, 300):
        histogram = dict(Counter(rng.integers(1, size + 1, 400).tolist()))
        patterns = packing.shortest_pack_first(histogram, size)
        assert Counter(x for p, n in patterns for x in p for _ in range(n)) == Counter(histogram)
        assert all(sum(p) <= size for p, _ in patterns)
        assert sum(n for _, n in patterns) <= 1.05 * len(brute_packs(histogram, size))


def test_packing_round_trip(sf_docs, plain_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack_documents(sf_docs).toPandas()
    pieces = defaultdict(list)
    for r in found.itertuples():
        pieces[r.doc_id].append(r)
    for doc, text, *_ in plain_docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    filled = found.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id").length.cumsum() - filled.length == filled.offset).all()
    sums = filled.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and sorted(sums.index) == list(range(len(sums)))
    assert sums.sum() / 2048 / len(sums) > 0.97


def test_special_token_text_like_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.byte_bpe(packing.default_ranks())
    for text in ("a<|endoftext|>b", "", " \n\t x", "ünï 😀   it's", "a" * 5000, "\x00<|endoftext|>"):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_like_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 10_000_000, "x" + "\n" * 2_000_000 + "<|endoftext|>y", " \t" * 1_000_000 + "z", "ab" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = defaultdict(list)
    for r in packing.token_pieces(docs).collect():
        found[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        cuts = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        assert sorted(found[doc]) == [(2048 * i, len(c), crc32(c.tobytes()), len(ids)) for i, c in enumerate(cuts)]


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r.doc_id for r in odd_docs.select("doc_id").collect())
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(no_docs).count() == 0


def test_ranks_are_gapless(spark):
    rows = [(i % 3, i // 7) for i in range(400)]
    df = rank_within(spark.createDataFrame(rows, "g long, x long"), ["g"], ["x"], "r")
    by_group = defaultdict(list)
    for r in df.collect():
        by_group[r.g].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in by_group.values())


def test_crc32_mod(spark):
    rows = spark.range(50).select("id", crc32_mod("id", 5).alias("m")).collect()
    assert all(r.m == crc32(str(r.id).encode()) % 5 for r in rows)
