"""Token functions against loops over random generations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ambilens.functions import tokens
from ambilens.operators.checks import InvalidInput
from ambilens.operators.evaluation import process_generations
from ambilens.operators.vocabulary import decode_tokens, spell_generations, vocabulary_texts

VOCABULARY = ["是", "否", " ", "。", "x", " 是", "　", "否 ", "</", "think>"]
END = (8, 9)
CHOICES = ("是", "否")
SCHEMA = (
    "id int, text string, token_ids array<int>, "
    "logprobs array<array<struct<token_id int, token string, logprob double, rank int>>>"
)


def generations(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ids = [rng.randrange(10) for _ in range(rng.randint(0, 9))]
        entries = []
        for token_id in ids:
            others = rng.sample(range(10), rng.randint(0, 4))
            listed = list(dict.fromkeys(([token_id] if rng.random() < 0.8 else []) + others))
            entries.append([
                (k, VOCABULARY[k] if rng.random() < 0.5 else None, -rng.random() * 4,
                 r + 1) for r, k in enumerate(listed)
            ] if rng.random() < 0.9 else None)
        rows.append((i, "".join(VOCABULARY[k] for k in ids), ids,
                     None if rng.random() < 0.05 else entries))
    return rows


def last_start(ids, wanted):
    starts = [i for i in range(len(ids) - len(wanted) + 1) if ids[i:i + len(wanted)] == list(wanted)]
    return starts[-1] if starts else None


def position(mode, ids, entries):
    if not ids or not entries:
        return None
    if mode == "default":
        return 0
    if mode == "thinking":
        start = last_start(ids, END)
        if start is None:
            return None
        return next((i for i in range(start + 2, len(ids)) if VOCABULARY[ids[i]].strip()), None)
    spelled = [i for i, k in enumerate(ids) if VOCABULARY[k].strip() in CHOICES]
    return spelled[-1] if spelled else None


def shares(entries, at):
    if at is None:
        return {c: None for c in CHOICES}, {c: None for c in CHOICES}
    raw = {c: sum(math.exp(p) for k, _, p, _ in entries[at] or () if VOCABULARY[k].strip() == c)
           for c in CHOICES}
    total = sum(raw.values())
    return raw, {c: raw[c] / total if total else 0.0 for c in CHOICES}


def texts():
    return F.array(*[F.lit(t) for t in VOCABULARY])


@pytest.mark.parametrize("mode", tokens.MODES)
def test_process_generations(spark, mode):
    data = generations(7)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.id: r for r in process_generations(df, mode, CHOICES, END, texts()).collect()}
    assert len(got) == len(data)
    for i, text, ids, entries in data:
        at = position(mode, ids, entries)
        assert got[i].decision_token_position == at, (mode, ids)
        raw, normalized = shares(entries, at)
        for name, want in (("raw", raw), ("normalized", normalized)):
            have = got[i].choice_probability[name]
            for choice in CHOICES:
                assert (have[choice] is None) == (want[choice] is None)
                if want[choice] is not None:
                    assert have[choice] == pytest.approx(want[choice], abs=1e-12)
        assert got[i].response == text.strip()


def test_last_subsequence(spark):
    data = generations(8)
    df = spark.createDataFrame(data, SCHEMA)
    for wanted in ((8, 9), (3,), (0, 1, 0)):
        got = dict(df.select("id", tokens.last_subsequence("token_ids", wanted)).collect())
        assert all(got[i] == last_start(ids, wanted) for i, _, ids, _ in data)
    assert {r[0] for r in df.select(tokens.last_subsequence("token_ids", ())).collect()} == {None}


def test_recorded_text_wins_over_the_vocabulary(spark):
    df = spark.createDataFrame([(0, "", [4], [[(4, "是", -1.0, 1)]])], SCHEMA)
    row = df.select(tokens.decision_position("token_ids", "logprobs", "cot", CHOICES, (), texts())).first()
    assert row[0] == 0


def test_token_records(spark):
    data = generations(9)
    df = spark.createDataFrame(data, SCHEMA)
    got = dict(df.select("id", tokens.token_records("token_ids", "logprobs", texts())).collect())
    for i, _, ids, entries in data:
        assert [t.token_id for t in got[i]] == ids
        for at, record in enumerate(got[i]):
            entry = (entries[at] if entries and at < len(entries) else None) or []
            assert record.token == VOCABULARY[ids[at]]
            assert record.sampled_logprob == {k: p for k, _, p, _ in entry}.get(ids[at])
            if entry:
                assert [(a.token_id, a.token, a.logprob, a.rank) for a in record.top] == [
                    (k, t or VOCABULARY[k], p, r) for k, t, p, r in entry]
            else:
                assert record.top is None


def test_unusable_alternatives_are_dropped(spark):
    df = spark.createDataFrame([(0, "", [1], [[(1, "否", None, 1), (2, None, -1.0, None)]])], SCHEMA)
    record = df.select(tokens.token_records("token_ids", "logprobs", texts())).first()[0][0]
    assert record.sampled_logprob is None and [a.token for a in record.top] == [" "]


def test_map_entries(spark):
    schema = "ids array<int>, e array<map<int, struct<logprob double, decoded_token string, rank int>>>"
    df = spark.createDataFrame([([3], [{3: (-0.5, "z", 1), 4: (-2.0, None, 2)}])], schema)
    entries = F.transform("e", tokens.entry_alternatives)
    record = df.select(tokens.token_records("ids", entries, texts())).first()[0][0]
    assert record.sampled_logprob == -0.5 and {a.token for a in record.top} == {"z", "x"}
    made = df.select(tokens.candidate(
        F.lit("t"), F.lit(-1), "ids", entries, F.lit("stop"), F.lit(7), texts()).alias("c")).first().c
    assert (made.text, made.cumulative_logprob, made.stop_reason) == ("t", -1.0, "7")
    assert made.tokens[0].token == "。"


def test_vocabulary(spark):
    entries = spark.createDataFrame([(0, "a"), (2, "]\"c,")], "token_id int, token string")
    texts_column = vocabulary_texts(entries)
    df = spark.createDataFrame([([0, 1, 2, 9],)], "ids array<int>")
    decoded = df.select(tokens.decode_ids("ids", texts_column)).first()[0]
    assert decoded == ["a", "1", "]\"c,", "9"]
    with pytest.raises(InvalidInput):
        vocabulary_texts(entries, max_rows=1)
    with pytest.raises(InvalidInput):
        vocabulary_texts(entries.unionByName(spark.createDataFrame([(-1, "x")], entries.schema)))
    with pytest.raises(InvalidInput):
        vocabulary_texts(entries.unionByName(spark.createDataFrame([(10**7, "x")], entries.schema)))
    flat = spark.createDataFrame(
        [(i, i % 4, "given" if i % 7 == 0 else None) for i in range(200)],
        "n int, token_id int, token string")
    wide = {r.n: r.token for r in decode_tokens(flat, entries).collect()}
    salted = {r.n: r.token for r in decode_tokens(flat, entries, max_rows=1).collect()}
    names = {0: "a", 1: "1", 2: "]\"c,", 3: "3"}
    assert wide == salted == {i: "given" if i % 7 == 0 else names[i % 4] for i in range(200)}


def test_joined_vocabulary_gives_the_same(spark):
    """Random generations, with entries null, empty and without recorded texts."""
    rng = random.Random(8)
    rows = []
    for n in range(120):
        ids = [rng.randrange(len(VOCABULARY) + 2) for _ in range(rng.randrange(9))]
        entries = []
        for i in ids:
            kind = rng.randrange(6)
            alts = [(j, rng.choice([None, None, "是"]), -0.1 * j, j) for j in {i, rng.randrange(12)}]
            entries.append(None if kind == 0 else [] if kind == 1 else alts)
        rows.append((n, "", ids, entries if n % 10 else None))
    made = spark.createDataFrame(rows, SCHEMA)
    entries = spark.createDataFrame(list(enumerate(VOCABULARY)), "token_id int, token string")
    texts = vocabulary_texts(entries)
    spelled = spell_generations(made, entries, ["id"], max_rows=1)
    for mode in tokens.MODES:
        fields = ["id", "decision_token_position", F.to_json("choice_probability").alias("p")]
        one = process_generations(made, mode, CHOICES, END, texts).select(*fields)
        two = process_generations(spelled, mode, CHOICES, END).select(*fields)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_spelling_moves_each_id_of_a_generation_once(spark):
    ids = [3, 259, 3, 515, 259, -1] * 50
    entries = [[(i, None, -0.1, 1), (i + 256, "是", -0.2, 2)] for i in ids]
    made = spark.createDataFrame([(1, "", ids, entries), (None, "", [3], [[(3, None, -0.1, 1)]])], SCHEMA)
    vocabulary = spark.createDataFrame([(3, "c"), (3, "b"), (259, "x"), (771, "y")], "token_id int, token string")
    spelled = spell_generations(made, vocabulary, ["id"])
    one, other = sorted(spelled.collect(), key=lambda r: r.id is None)
    texts = {3: "b", 259: "x", 515: "515", -1: "-1"}
    assert one.spelled == [texts[i] for i in ids]
    assert [[a.token for a in entry] for entry in one.logprobs] == [[texts[i], "是"] for i in ids]
    assert other.spelled == [] and other.logprobs[0][0].token is None
    plan = spelled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1
