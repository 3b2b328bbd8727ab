"""Prompts out, completions in, archive stored and extracted."""

import pytest
from pyspark.sql import functions as F

from ambilens.operators import archive
from ambilens.plans import sampling

COMPLETIONS = (
    "index bigint, candidate_index int, text string, cumulative_logprob double, token_ids array<int>, "
    "logprobs array<array<struct<token_id int, token string, logprob double, rank int>>>, "
    "finish_reason string, stop_reason string"
)


def test_sampling_round_trip(spark, tmp_path):
    corpus = spark.range(300).select(
        F.col("id").alias("index"), (F.col("id") + 2).alias("row_number"),
        F.concat(F.lit("句"), "id").alias("src"), (F.col("id") % 2).cast("tinyint").alias("ambiguity"))
    requests = sampling.translation_requests(corpus, "org/Qwen2.5-7B")
    first = requests.where("index = 0").first()
    assert first.model_type == "base" and first.prompt.endswith('Chinese: "句0"\nEnglish: "')
    rows = [(i, c, f'{i}-{c}" ', -1.0, [3], [[(3, "x", -0.5, 1)]], "stop", None)
            for i in range(300) for c in (2, 0, 1)]
    made = sampling.completion_candidates(spark.createDataFrame(rows, COMPLETIONS))
    config = {"model": "org/Qwen2.5-7B", "model_type": "base", "dataset": "D", "sampling_params": {"n": 3}}
    records = sampling.sample_records(sampling.samples(requests, made), config)
    with pytest.raises(ValueError, match="records"):
        sampling.write_archive(records, str(tmp_path / "archive"))
    path = str(tmp_path / "archive.records")
    sampling.write_archive(records, path)
    with pytest.raises(FileExistsError):
        sampling.write_archive(records, path)
    stored = spark.read.parquet(path)
    spans = stored.where("type = 'batch'").orderBy("seq").select("path", "start_index", "end_index").collect()
    assert [tuple(r) for r in spans] == [
        ("qwen2.5_7b", 0, 128), ("qwen2.5_7b", 128, 256), ("qwen2.5_7b", 256, 300)]
    token = stored.where("seq = 1").first().samples[5].candidates[1].tokens[0]
    assert (token.token_id, token.sampled_logprob, token.top[0].token) == (3, -0.5, "x")
    assert archive.archive_errors(stored).first().reason is None
    flat = archive.flatten_candidates(archive.carry_metadata(stored))
    got = {(r.source_index, r.candidate_index): (r.processed_text, r.model, r.source_text) for r in flat.collect()}
    assert got == {(i, c): (f"{i}-{c}", "org/Qwen2.5-7B", f"句{i}") for i in range(300) for c in range(3)}
    short = sampling.samples(requests, made.where("index <> 7"))
    with pytest.raises(Exception, match="No completion for request 7"):
        short.collect()
