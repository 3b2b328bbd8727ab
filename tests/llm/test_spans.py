import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ambilens.llm import identifiers, pii
from ambilens.llm.queries import op4_markov_secrets, op6_weak_supervision_pii

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plain_secrets(text):
    out = []
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(identifiers.KINDS[k], s, e) for s, k, e in sorted(out)]


def tricky(rng, n, bits):
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(n)]


PII_BITS = ["a", "B9", "@", ".", "c.d", "x@y.z", " ", "-", "+", "1", "255", "256", "4111 1111 1111 1111", "(", ")", "é", "😀",
            "10.0.0.1", "+1 (555) 555-5555", "_", "%", "0000", "..", "1.2.3"]
SECRET_BITS = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", "=", ":", " ", '"', "'", "abcdef", "x" * 7, "é", "ſ",
               "AKIA", "AKIA" + "Z" * 16, "Q2", "0123456789abcdef" * 2, "deadbeef", "g", "/", ".", "\n", "K"]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_pii_base_spans_like_plain_patterns(spark):
    texts = tricky(random.Random(4), 1500, PII_BITS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        base = [(s.kind, s.start, s.end) for s in r.pii_spans if s.base]
        assert base == plain_pii(texts[r.doc_id]), texts[r.doc_id]


def test_secret_base_spans_like_plain_patterns(spark):
    texts = tricky(random.Random(5), 3000, SECRET_BITS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in identifiers.detect(docs).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind != "markov"]
        assert base == plain_secrets(texts[r.doc_id]), texts[r.doc_id]


def test_registered_queries(spark, plain_docs):
    texts = {d: t or "" for d, t, *_ in plain_docs}
    for r in op6_weak_supervision_pii(spark, SF).collect():
        assert r.base_sha256 == digest(plain_pii(texts[r.doc_id]))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(plain_pii(texts[r.doc_id]))
    for r in op4_markov_secrets(spark, SF).collect():
        assert r.base_sha256 == digest(plain_secrets(texts[r.doc_id]))


def test_markov_finds_unlabelled_strings_and_leaves_words(spark):
    rng = random.Random(1)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    words = "the_quick brown fox jumps over lazy dogs and then some other ordinary identifiers follow".split()
    texts = [" ".join(rng.choice(words) for _ in range(300)) + f" token={alnum(40)} secret: {hexa(32)} " for _ in range(60)]
    hidden = alnum(32)
    texts += [f"nothing here {hidden} end", "some_other_ordinary_identifiers2 follow", "12345678901234567890"]
    found = identifiers.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans[60] == [("markov", 13, 45)] and spans[61] == [] and spans[62] == []


def test_overlapping_spans_count_once(spark):
    value = "0123456789abcdef" * 2
    rows = {r.cell: r.n for r in identifiers.count(spark.createDataFrame([(f'token="{value}" x',)], "text string")).collect()}
    found = np.zeros(2 * identifiers.CELLS, int)
    found[list(rows)] = list(rows.values())
    own = identifiers.transitions(identifiers.states(value))
    every = identifiers.transitions(identifiers.states(f'token="{value}" x'))
    assert (found[identifiers.CELLS :] == own).all() and (found[: identifiers.CELLS] == every - own).all()


def test_transitions_in_blocks():
    text = "ab9" * 700_000
    counts = identifiers.transitions(identifiers.states(text)).reshape(identifiers.STATES, -1)
    assert counts.sum() == len(text) - 1
    a, b = identifiers.states("ab")
    assert counts[a, b] == 700_000


def test_labelers_learn_from_agreement():
    counts = {("card", "1,1,0,1"): 80, ("card", "-1,-1,0,1"): 60, ("email", "1,1,1,1"): 50, ("email", "0,0,-1,-1"): 30}
    p = pii.fit_labelers(counts)
    assert p["card", "1,1,0,1"] > 0.9 and p["email", "1,1,1,1"] > 0.9
    assert p["card", "-1,-1,0,1"] < 0.5 and p["email", "0,0,-1,-1"] < 0.5
    assert pii.fit_labelers({k: 1000 * n for k, n in counts.items()}).keys() == p.keys()


def test_labelers_are_estimated_at_any_size():
    """Generated votes: two labelers 97 % right, one always wrong, one without opinion."""
    for n, near in ((100_000, 0.02), (2000, 0.05)):
        rng = random.Random(n)
        counts, personal = {}, {}
        for _ in range(n):
            truth = 1 if rng.random() < 0.1 else -1
            right = lambda: truth if rng.random() < 0.97 else -truth  # noqa: E731, B023
            key = "email", f"{right()},{-truth},0,{right()}"
            counts[key] = counts.get(key, 0) + 1
            personal[key] = personal.get(key, 0) + (truth > 0)
        posterior = pii.fit_labelers(counts)
        for key, count in counts.items():
            if count > n / 100:  # patterns of several wrong votes are few
                assert abs(posterior[key] - personal[key] / count) < near, key
        for i, right in ((0, 0.97), (1, 0.0), (3, 0.97)):
            for side in (1, -1):
                assert abs(pii.reliabilities(counts, posterior)[i][side][side] - right) < 0.05


def test_classifier_adds_loose_forms_with_cues(spark):
    texts = [f"please call phone +1 (555) 555-{1000 + i} or mail a{i}@b.com" for i in range(50)]
    texts += ["phone (555) 555-1234 today", "isbn page no 4111111111111112 xx"]
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = {r.doc_id: [(s.kind, s.start, s.base) for s in r.pii_spans] for r in rows.collect()}
    assert spans[0] == [("email", 44, True), ("phone", 18, True)]
    assert spans[50] == [("phone", 6, False)] and spans[51] == []


def test_mask_and_odd_rows(spark, odd_docs, no_docs):
    text = "x 4111 1111 1111 1111, +1 (555) 555-5555 é a@b.co."
    docs = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "none", None)], "doc_id long, text string, extra string")
    found = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert found == {1: "x [CARD], [PHONE] é [EMAIL].", 2: None, 3: "none"}
    assert pii.mask(docs).columns == docs.columns
    for detect in (pii.detect, identifiers.detect):
        assert detect(odd_docs).count() == odd_docs.count() and detect(no_docs).count() == 0
    assert pii.mask(odd_docs).columns == odd_docs.columns and pii.mask(no_docs).count() == 0


def plain_mask(text, spans):
    out, at = [], 0
    for start, kind, end in sorted((s.start, s.kind, s.end) for s in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_mask_like_plain_replacement(spark):
    rng = random.Random(9)
    texts = tricky(rng, 300, PII_BITS) + ["".join(rng.choice(PII_BITS) for _ in range(n)) for n in (600, 3000, 20_000)]
    texts += ["é" * 255 + "a@b.co", "😀" * 256 + "a@b.co" + "x" * 600, "+" + "1 " * 700 + "2 a@b.c", "z " * 300 + "x@" + "y." * 900 + "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__pii", F.lit("own"))
    spans = {r.doc_id: r.pii_spans for r in pii.detect(docs).collect()}
    for r in pii.mask(docs).collect():
        assert r.text == plain_mask(texts[r.doc_id], spans[r.doc_id]) and r["__pii"] == "own"


def test_loose_spans_that_base_spans_overlap_go(spark):
    texts = [" ".join(rng.choice(["+1 555-555-1234", "555-555-1234", "x@y.z", "a (at) b.com", "b@c (at) d.e", "phone"])
                      for _ in range(400)) for rng in map(random.Random, range(8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(docs)
    free = found.select("candidates", pii._free(F.col("candidates")).alias("free")).collect()
    for r in free:
        base = [(s.start, s.end) for s in r.candidates if s.base]
        loose = [(s.start, s.end) for s in r.candidates if not s.base]
        wanted = [(a, b) for a, b in loose if not any(x < b and a < y for x, y in base)]
        assert sorted((s.start, s.end) for s in r.free) == sorted(wanted) and 0 < len(wanted) < len(loose)


def test_very_many_spans_in_one_text(spark):
    many = 100_000
    text = " ".join(f"a{i}@b{i % 7}.com" for i in range(many))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.detect(docs).first().pii_spans
    assert [(s.start, s.end) for s in spans] == [m.span() for m in re.finditer(r"\S+", text)]
    assert pii.mask(docs).first().text == " ".join(["[EMAIL]"] * many)


def test_long_runs_are_linear(spark):
    long = ["a" * 300_000, "1" * 300_000, "a@" + "b." * 100_000 + "c", "1." * 100_000, "+1" + " " * 200_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert pii.detect(docs).select(F.sum(F.size("pii_spans"))).first()[0] >= 1
    assert identifiers.detect(docs).count() == 5


def test_pii_runs_no_python_on_executors(sf_docs):
    plan = pii.candidates(sf_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ratio_prefers_the_random_model():
    counts = np.zeros(2 * identifiers.CELLS, np.int64)
    for word in ["ordinary", "words", "andother"] * 20:
        counts[: identifiers.CELLS] += identifiers.transitions(identifiers.states(word))
    for word in ["x9Q2z7", "7zK1q9"] * 20:
        counts[identifiers.CELLS :] += identifiers.transitions(identifiers.states(word))
    ratio = identifiers.ratios(counts)
    assert identifiers.score("x9Q2z7K1q9", ratio) > 0 > identifiers.score("wordsandother", ratio)


def test_markov_scores_short_letters_only_and_embedded_strings(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    drawn = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    path = "then/some/other/ordinary-identifiers/follow"
    words = f"the_quick brown fox jumps over lazy.dogs and {path} name=value 2019 34 5678".split()
    words += [w.upper() for w in words] + [w.title() for w in words]
    texts = [" ".join(rng.choice(words) for _ in range(300)) + f" token={drawn(400, letters + '0123456789')} " for _ in range(80)]
    short, parts = drawn(14, letters + "0123456789"), [drawn(10, letters + "0123456789") for _ in range(2)]
    plain = [drawn(24, letters) for _ in range(4)]
    texts += [
        f"see {short} end", f"see {plain[0]} end", f"{path.upper()}/{plain[1]}/{path.upper()}",
        f"see {'.'.join(parts)}", f"token=abcdefgh,{plain[2]}", f"token=abcdefgh\"{plain[3]} x", path + "/some",
    ]
    found = identifiers.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "markov"] for r in found.collect()}
    assert spans[80] == [short] and spans[81] == [plain[0]] and spans[84] == [plain[2]] and spans[85] == [plain[3]]
    assert len(spans[82]) == 1 and plain[1] in spans[82][0] and len(spans[82][0]) < 32
    assert "".join(spans[83]).replace(".", "") == "".join(parts)
    assert not any(spans[k] for k in [*range(80), 86])


def test_a_base_span_leaves_the_rest_of_its_run():
    ratio = np.full((identifiers.STATES, identifiers.STATES), 2.0)
    assert identifiers.random_spans("x" * 40, [(0, 20)], ratio, 12.0) == [(20, 40)]
    assert identifiers.random_spans("x" * 40 + " " + "y" * 7, [], ratio, 12.0) == [(0, 40)]
