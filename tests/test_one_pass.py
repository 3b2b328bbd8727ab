"""One pass over candidates, batches by length, records by bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambilens.operators import archive, scoring
from ambilens.operators.checks import InvalidInput
from ambilens.operators.unique import aggregate_candidates, excluded_empties
from ambilens.plans import sampling, translation

CANDIDATES = "source_index bigint, source_text string, ambiguity tinyint, processed_text string"


def test_candidates_are_read_once(spark, tmp_path):
    log = str(tmp_path / "reads")

    def count(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write(f"{len(batch)}\n")
            yield batch

    rows = [(i % 7 if i % 11 else None, f"s{i % 7}" if i % 11 else "none", 0, ["a", "b", "", " ", None, f"t{i % 5}"][i % 6]) for i in range(500)]
    plain = spark.createDataFrame(rows, CANDIDATES).repartition(4)
    totals = translation.aggregate_job(plain.mapInPandas(count, CANDIDATES), str(tmp_path / "unique"))
    with open(log) as f:
        assert sum(map(int, f)) == 500
    want = sorted(map(tuple, aggregate_candidates(plain).collect()), key=repr)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "unique")).collect()), key=repr) == want
    assert (totals.n_rows, totals.n_empty) == tuple(excluded_empties(plain).first()) and totals.n_unique == len(want)
    split = plain.withColumn("ambiguity", F.when(F.col("processed_text") == "a", 1).otherwise(0).cast("tinyint"))
    with pytest.raises(InvalidInput, match="Inconsistent"):
        translation.aggregate_job(split, str(tmp_path / "bad"))
    assert translation.aggregate_job(plain.where("false"), str(tmp_path / "none")).n_unique == 0


def test_batches_by_length_pad_little():
    rng = np.random.default_rng(14)
    lengths = rng.integers(1, 400, 3000)
    lengths[7] = 90_000
    batches = list(scoring.length_batches(lengths, batch_size=64, budget=6000))
    assert sorted(np.concatenate(batches).tolist()) == list(range(3000))
    padded = [len(b) * lengths[b].max() for b in batches]
    assert max(len(b) for b in batches) <= 64
    assert all(p <= 6000 or len(b) == 1 for p, b in zip(padded, batches))
    assert sum(padded) < 1.1 * lengths.sum()
    assert [b.tolist() for b in scoring.length_batches([0, 0, 0], batch_size=2)] == [[0, 1], [2]]
    assert list(scoring.length_batches([], 3, 9)) == []


def test_scores_come_back_to_their_pairs(spark):
    def load():
        def score(ones, twos):
            assert len(ones) == 1 or len(ones) * max(len(a) + len(b) for a, b in zip(ones, twos)) <= 200
            return [[len(a) / 1000, len(b) / 1000, 1 - (len(a) + len(b)) / 1000] for a, b in zip(ones, twos)]
        return score

    rows = [("a" * (i * 37 % 101), "b" * (i * 53 % 97)) for i in range(400)]
    pairs = spark.createDataFrame(rows, "sentence1 string, sentence2 string").repartition(3)
    for row in scoring.batch_scorer(load, batch_size=16, budget=200)(pairs).collect():
        assert np.allclose(row.probabilities[:2], [len(row.sentence1) / 1000, len(row.sentence2) / 1000])


def test_nested_sizes(spark):
    kind = "struct<a: string, b: array<struct<c: string, d: int>>, e: bigint>"
    made = spark.createDataFrame([(("xyz", [("é", 1), (None, 2)], 4),), (None,), ((None, None, None),)], f"v {kind}")
    sizes = [r[0] for r in made.select(archive.nested_bytes(F.col("v"), made.schema["v"].dataType)).collect()]
    # 8 a value, and the texts: struct, "xyz", array, two structs with two fields, number. A null one counts its fields.
    assert sizes == [8 + (8 + 3) + (8 + (8 + 8 + 2 + 8) + (8 + 8 + 8)) + 8, 32, 32]


def test_a_batch_of_huge_samples_is_cut(spark):
    rows = [(i, i + 2, f"s{i}", 0, "p", [("x" * (3000 if i in (3, 4, 9) else 5), True, None)]) for i in range(20)]
    kind = ("index bigint, row_number bigint, src string, ambiguity int, prompt string, "
            "candidates array<struct<text: string, is_text: boolean, finish_reason: string>>")
    samples = spark.createDataFrame(rows, kind).repartition(3)
    config = {"model": "org/m", "model_type": "base"}
    whole, cut = (sampling.sample_records(samples, config, 8, n) for n in (1 << 40, 2000))
    sizes = {r.start_index: (r.end_index, len(r.samples)) for r in cut.where("type = 'batch'").collect()}
    assert {r.start_index: r.end_index for r in whole.where("type = 'batch'").collect()} == {0: 8, 8: 16, 16: 20}
    assert len(sizes) > 3 and sum(n for _, n in sizes.values()) == 20 and all(e - s == n for s, (e, n) in sizes.items())
    assert 4 in sizes and 5 in sizes  # no record holds two of the huge ones
    flat = [sorted(map(tuple, archive.flatten_candidates(archive.carry_metadata(r)).collect())) for r in (whole, cut)]
    assert flat[0] == flat[1] and len(flat[0]) == 20
    assert cut.select("seq").distinct().count() == cut.count()
