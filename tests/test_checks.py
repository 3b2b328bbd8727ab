"""Each validation has a table that passes and one that fails."""

import pytest
from pyspark.sql import functions as F

from ambilens.functions import scores
from ambilens.operators import checks

SCHEMA = "source_index bigint, source_text string, ambiguity tinyint, processed_text string"
GOOD = [(1, "s", 0, "a"), (1, "s", 0, "b"), (2, None, None, "a"), (None, "x", 0, "q"), (None, "y", 1, "r")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_required_columns(spark):
    df = frame(spark, GOOD)
    checks.require_columns(df, checks.UNIQUE_COLUMNS)
    with pytest.raises(checks.InvalidInput, match=r"\['b', 'c'\]"):
        checks.require_columns(df, ["source_index", "c", "b"])


def test_validate_unique(spark):
    sound = [row for row in GOOD if row[1]]
    assert checks.validate_unique(frame(spark, sound)).count() == len(sound)
    for extra, message in [
        ((3, "s", 0, "　"), "empty source or text, source_index: 3"),
        ((3, None, 0, "t"), "empty source or text"),
        ((1, "s", 0, "a"), "Duplicate"),
        ((1, "other", 0, "c"), r"Inconsistent source metadata, source_index: \[1\]"),
        ((1, "s", None, "c"), "Inconsistent"),
    ]:
        with pytest.raises(checks.InvalidInput, match=message):
            checks.validate_unique(frame(spark, [*sound, extra]))


def test_null_counts_as_a_value_and_null_keys_are_skipped(spark, rows):
    df = frame(spark, [*GOOD, (2, "t", None, "z")])
    assert rows(checks.source_consistency(df)) == [(1, 1, 1), (2, 2, 1)]
    assert rows(checks.inconsistent_sources(df)) == [(2, 2)]
    checks.assert_consistent(frame(spark, GOOD))
    with pytest.raises(checks.InvalidInput):
        checks.assert_consistent(df)


def test_preview_is_bounded(spark):
    df = spark.range(100).withColumn("t", F.when(F.col("id") > 10, " ").otherwise("x"))
    found = [r.id for r in checks.preview(df, checks.any_blank(["t"]), "id").collect()]
    assert found == list(range(11, 31))


def test_labels(spark):
    df = spark.createDataFrame([("0",), ("1",), ("x",), ("2",), ("2",), (None,), ("1.0",)], "l string")
    assert df.where(checks.is_bad_label("l")).count() == 5
    found = dict(checks.offending_labels(df, "l").collect())
    assert found == {"x": 1, "2": 2, "1.0": 1, None: 1}
    assert checks.offending_labels(df.where("l in ('0', '1')"), "l").isEmpty()


def test_same_keys(spark):
    left = spark.range(50)
    checks.assert_same_keys(left, left, ["id"])
    with pytest.raises(checks.InvalidInput, match="2 keys"):
        checks.assert_same_keys(left, left.where("id > 0").union(spark.range(7, 8)), ["id"])


def test_probabilities(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.2, 0.3, 0.5], None), ([1.0, 0.0, 0.00009], None),
            ([0.2, 0.8], "not three values"), (None, "not three values"),
            ([0.2, 0.3, 0.4], "values do not sum to one"),
            ([nan, 0.5, 0.5], "value is not finite"), ([inf, 0.0, 0.0], "value is not finite"),
            ([-inf, 0.0, 1.0], "value is not finite"), ([0.5, 0.5, None], "value is not finite"),
            ([1.5, -0.5, 0.0], "value outside [0, 1]")]
    df = spark.createDataFrame(rows, "p array<double>, want string")
    for row in df.withColumn("got", scores.probability_error("p")).collect():
        assert row.got == row.want, row
    good = df.where("want is null")
    assert good.select(scores.checked_probabilities("p")).count() == 2
    with pytest.raises(Exception, match="do not sum to one"):
        df.where("want like '%sum%'").select(scores.checked_probabilities("p")).collect()


def test_labels_of_a_classifier(spark):
    assert scores.label_positions({0: "Neutral ", 1: "ENTAILMENT", 2: "contradiction"}) == [1, 0, 2]
    for bad in ({0: "neutral", 1: "entailment"}, {0: "neutral", 1: "entailment", 2: "other"}):
        with pytest.raises(ValueError):
            scores.label_positions(bad)
    df = spark.createDataFrame([("　Not Equivalent",)], "l string")
    assert df.select(scores.normalize_label("l")).first()[0] == "neutral"
    with pytest.raises(Exception, match="Unknown classifier label"):
        df.select(scores.normalize_label(F.lit("maybe"))).collect()
    logits = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    got = logits.select(
        scores.softmax("x").alias("s"),
        scores.probabilities_from_logits("x", {0: "neutral", 1: "entailment", 2: "contradiction"}).alias("p"),
    ).first()
    assert sum(got.s) == pytest.approx(1) and got.p == pytest.approx([got.s[1], got.s[0], got.s[2]])


def test_top_label_ties_go_to_the_earlier_label(spark):
    df = spark.createDataFrame(
        [([0.4, 0.4, 0.2],), ([0.2, 0.4, 0.4],), ([0.1, 0.2, 0.7],)], "p array<double>")
    got = [r[0] for r in df.select(scores.display_label(scores.top_label("p"))).collect()]
    assert got == ["Equivalent", "Neutral", "Contradiction"]


def test_cache_key(spark):
    import hashlib
    import json

    texts = ['a"\\', "é\n\t", "是", "😀", "z/", " "]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts if a != b], "a string, b string")
    for row in df.withColumn("k", scores.cache_key("m/é", "r", "a", "b")).collect():
        payload = json.dumps(["m/é", "r", *sorted([row.a, row.b])], ensure_ascii=False, separators=(",", ":"))
        assert row.k == hashlib.sha256(payload.encode()).hexdigest()
    with pytest.raises(Exception, match="no pair with itself"):
        df.select(scores.cache_key("m", "r", "a", "a")).collect()
