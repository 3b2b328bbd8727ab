"""The registered queries: one or more per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambilens.functions import names, prompts, scores, text, tokens
from ambilens.operators import archive, checks, evaluation, pairs, scoring, unique
from ambilens.operators.ordinals import with_ordinal
from ambilens.operators.skew import lookup_join
from ambilens.operators.vocabulary import decode_tokens
from ambilens.plans import extract, inputs, sampling
from ambilens.plans.stored import STORED_QUERIES
from ambilens.session import scratch_path, shuffles_removed, stage
from ambilens.sinks.tables import delete

Query = Callable[[SparkSession, str], DataFrame]

PROBABILITIES = ("equivalent_prob", "neutral_prob", "contradiction_prob")


def micro(value: Column) -> Column:
    """A probability as an integer in millionths, so that values hash alike."""
    return F.floor(value * 1e6 + 0.5).cast("bigint")


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumns({name: micro(F.col(name)) for name in PROBABILITIES})


# -- candidates ---------------------------------------------------------------

def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.candidates(spark, sf_dir)
    return rows.withColumn("processed_text", text.clean_translation("raw_text"))


def clean_translation(spark, sf_dir):
    return processed(spark, sf_dir).select(
        "source_index", "model", "candidate_index", "processed_text", "finish_reason"
    )


def flatten_candidates(spark, sf_dir):
    return archive.flatten_candidates(inputs.document_records(spark, sf_dir))


def carry_metadata(spark, sf_dir):
    carried = archive.carry_metadata(inputs.conversation_records(spark, sf_dir))
    return carried.select("path", "seq", F.col("config.model").alias("model"))


def carried_candidates(spark, sf_dir):
    """Candidates of the archives whose records are sound."""
    records = inputs.conversation_records(spark, sf_dir)
    sound = archive.archive_errors(records).where("reason is null").select("path")
    whole = lookup_join(records, sound, ["path"], how="inner", spread=["seq"])
    return archive.flatten_candidates(archive.carry_metadata(whole), keep=["path", "seq"])


def record_checks(spark, sf_dir):
    return archive.archive_errors(inputs.conversation_records(spark, sf_dir))


def extract_status(spark, sf_dir):
    records = inputs.conversation_records(spark, sf_dir)
    records = records.withColumn("path", F.concat(F.lit("/raw/p/d/"), "path", F.lit(".pkl.gz")))
    return extract.archive_status(records, "/raw")


def extract_summary(spark, sf_dir):
    return extract.status_summary(extract_status(spark, sf_dir))


def sampled_candidates(spark, sf_dir):
    """Lines of documents as completions, stored as batches and flattened again."""
    docs = inputs.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "index")
    requests = sampling.translation_requests(
        docs.select(
            "index", (F.col("index") + 2).alias("row_number"), F.col("source").alias("src"),
            (F.col("lang") == "en").cast("tinyint").alias("ambiguity"),
        ),
        "org/Qwen3-8B-Base",
    )
    lines = docs.select("index", F.posexplode(F.split("text", "\n")).alias("candidate_index", "text"))
    alternative = F.struct(
        F.lit(0).alias("token_id"), F.lit("t").alias("token"), F.lit(-0.5).alias("logprob"), F.lit(1).alias("rank")
    )
    completions = lines.select(
        "*", F.lit(-1.0).alias("cumulative_logprob"), F.array(F.lit(0)).alias("token_ids"),
        F.array(F.array(alternative)).alias("logprobs"), F.lit("stop").alias("finish_reason"),
        F.lit(None).cast("string").alias("stop_reason"),
    )
    candidates = sampling.completion_candidates(completions)
    config = {"model": "org/Qwen3-8B-Base", "model_type": "base"}
    records = sampling.sample_records(sampling.samples(requests, candidates), config)
    return archive.flatten_candidates(archive.carry_metadata(records))


def batch_records(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    samples = docs.select(F.col("doc_id").alias("index"), F.col("text").alias("src"), "lang")
    stored = archive.batch_records(samples, 128, keys=["lang"])
    return stored.select(
        "lang", "start_index", "end_index", "type",
        F.size("samples").cast("bigint").alias("n_samples"),
        F.col("samples")[0]["src"].alias("first_src"),
        F.sha2(F.array_join("samples.src", "|"), 256).alias("all_src"),
    )


# -- corpus -------------------------------------------------------------------

def corpus_records(spark, sf_dir):
    numbered = with_ordinal(inputs.corpus_source(spark, sf_dir), ["doc_id"])
    return numbered.select(
        "index", (F.col("index") + 2).alias("row_number"), "src",
        F.col("ambiguity").cast("tinyint").alias("ambiguity"),
    )


def label_checks(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    label = F.when(F.col("lang") == "fr", "x").when(F.col("lang") == "de", "2")
    label = label.when(F.col("lang") == "es", "1").otherwise("0")
    return checks.offending_labels(docs.select(label.alias("label")), "label")


def blank_preview(spark, sf_dir):
    rows = processed(spark, sf_dir)
    # One position for both models' rows of a document.
    place = F.struct("candidate_index", "model")
    bad = checks.preview(rows.withColumn("at", place), text.is_blank("processed_text"), "at")
    return bad.select("candidate_index", "model", "source_index")


# -- unique translations ------------------------------------------------------

def source_consistency(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    rows = docs.select(
        F.substring("source", 4, 20).cast("bigint").alias("source_index"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("source_text"),
        (F.col("source") == "src1").cast("tinyint").alias("ambiguity"),
    )
    return checks.source_consistency(rows)


def inconsistent_sources(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.col("conv_id").alias("source_index"),
        F.when(F.col("role") != "system", F.col("role")).alias("source_text"),
        F.lit(0).alias("ambiguity"),
    )
    return checks.inconsistent_sources(rows)


def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(processed(spark, sf_dir), ["source_index", "processed_text"])


def excluded_empties(spark, sf_dir):
    return unique.excluded_empties(processed(spark, sf_dir))


def unique_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique.unique_translations(processed(spark, sf_dir), orphans=False)


def unique_translations(spark, sf_dir):
    return unique.unique_translations(processed(spark, sf_dir), ordered=True, orphans=False)


# -- pairs and scores ---------------------------------------------------------

def pair_count_estimate(spark, sf_dir):
    return pairs.pair_estimate(unique_table(spark, sf_dir))


def source_groups(spark, sf_dir):
    groups = pairs.source_groups(stage(unique_table(spark, sf_dir), "unique"), block=32)
    return groups.select(
        "source_index", "block_index", "source_text", "ambiguity",
        F.size("texts").cast("bigint").alias("n_texts"),
        F.array_join("texts", "|").alias("texts"),
    )


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.translation_pairs(stage(unique_table(spark, sf_dir), "unique"))


def translation_pairs(spark, sf_dir):
    stored = stage(unique_table(spark, sf_dir), "unique")
    return pairs.translation_pairs(stored, ordered=True)


def pairs_per_source(spark, sf_dir):
    return pair_table(spark, sf_dir).groupBy("source_index").agg(F.count("*").alias("n_pairs"))


def unique_stored(spark: SparkSession, sf_dir: str, ended: bool = False) -> DataFrame:
    """The unique table, stored. ``ended`` keeps the candidates that ended by
    themselves, as an earlier run saw."""
    rows = processed(spark, sf_dir)
    if ended:
        rows = rows.where(F.col("finish_reason") == "stop")
    return stage(unique.unique_translations(rows, orphans=False), "unique")


def paired(stored: DataFrame) -> DataFrame:
    """Keyed pairs of a stored unique table."""
    return scoring.keyed_translation_pairs(stored, inputs.MODEL, inputs.REVISION)


def cache_keys(spark, sf_dir):
    wanted = paired(unique_stored(spark, sf_dir))
    return wanted.select("source_index", "sentence1", "sentence2", "cache_key")


SCORER = scoring.logit_scorer(inputs.pair_logits, inputs.LABEL_MAP)


def scored(df: DataFrame) -> DataFrame:
    return scoring.predictions(SCORER(df), inputs.MODEL, inputs.REVISION)


def earlier_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of an earlier run."""
    stored = unique_stored(spark, sf_dir, ended=True)
    return stage(first_scores(spark, scoring.narrow_pairs(paired(stored)), stored), "cache")


def first_scores(spark: SparkSession, narrow: DataFrame, stored: DataFrame) -> DataFrame:
    nothing = spark.createDataFrame([], "cache_key string")
    return scored(scoring.missing_pairs(narrow, nothing, stored))


def flagged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique table, stored, with what an earlier run saw of it: texts that a
    candidate which ``ended`` by itself had. Candidates are read once."""
    rows = processed(spark, sf_dir).where(~text.is_blank("processed_text"))
    flagged = rows.groupBy(*checks.UNIQUE_COLUMNS).agg(F.max(F.col("finish_reason") == "stop").alias("ended"))
    return stage(flagged.withColumn("ended", F.coalesce("ended", F.lit(False))), "unique")


def narrow_runs(stored: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Narrow pairs, stored, with whether the earlier run had them: both texts did."""
    keyed = scoring.keyed_translation_pairs(stored, inputs.MODEL, inputs.REVISION, carry=["ended"], **options)
    both = (F.col("ended1") & F.col("ended2")).alias("earlier")
    return stage(scoring.narrow_pairs(keyed, [both]), "pairs", path)


class Run(NamedTuple):
    """A cell of a job: its texts, its narrow pairs, and the cache of an earlier run, stored."""

    texts: DataFrame
    narrow: DataFrame
    known: DataFrame
    folder: str


def two_runs(stored: DataFrame) -> Iterator[Run]:
    """All pairs of the stored texts and the cache of an earlier run, one cell after the other.

    Equal keys are in one cell, so its pairs need no cache but its own. What a cell stored and
    shuffled goes before the next one, so disk holds the pairs of one cell, however many
    there are; what a caller keeps of it comes on top.
    """
    spark = stored.sparkSession
    with shuffles_removed(spark):
        plan = pairs.plan_pairs(stored)
        for cell in pairs.cells(plan):
            texts = cell.texts(stored)
            folder = scratch_path(spark, "cell")
            narrow = narrow_runs(texts, f"{folder}/pairs", plan=plan, cell=cell)
            first = narrow.where("earlier").drop("earlier")
            known = stage(first_scores(spark, first, texts), path=f"{folder}/cache")
            yield Run(texts, narrow.drop("earlier"), known, folder)
            delete(spark, folder)


def kept(spark: SparkSession, name: str, parts: Iterator[DataFrame]) -> DataFrame:
    """What is kept of each part, stored before the next one is made."""
    path = scratch_path(spark, name)
    for part in parts:
        part.write.option("compression", "zstd").mode("append").parquet(path)
        schema = part.schema
    return spark.read.schema(schema).parquet(path)


def cache_misses(spark, sf_dir):
    stored = flagged_texts(spark, sf_dir)
    absent = (scoring.absent_keys(scoring.wanted_keys(run.narrow), run.known) for run in two_runs(stored))
    return scoring.spelled_pairs(kept(spark, "absent", absent), stored)


def cache_hits(spark, sf_dir):
    wanted = paired(unique_stored(spark, sf_dir))
    hits = scoring.cached_hits(wanted, earlier_cache(spark, sf_dir))
    return _micros(hits.drop("nli_model", "nli_revision"))


def cache_upsert(spark, sf_dir):
    """Earlier entries and a run over all pairs, the first writer kept."""
    old = earlier_cache(spark, sf_dir).withColumn("run_seq", F.lit(0))
    wanted = paired(unique_stored(spark, sf_dir))
    entries = old.unionByName(scored(wanted).withColumn("run_seq", F.lit(1)))
    kept = scoring.first_writer(entries, ["run_seq"])
    return kept.select("cache_key", "sentence1", "sentence2", "prediction", "run_seq")


def softmax_scores(spark, sf_dir):
    logits = inputs.pair_logits(F.col("sentence1"), F.col("sentence2"))
    rows = pair_table(spark, sf_dir).withColumn("p", scores.softmax(logits))
    rows = rows.withColumn("p", scores.checked_probabilities("p"))
    return rows.select(
        "source_index", "sentence1", "sentence2",
        *[micro(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)],
    )


def label_scores(spark, sf_dir):
    wanted = paired(unique_stored(spark, sf_dir))
    return scored(wanted).select("cache_key", "prediction", "is_equivalent")


def normalized_labels(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in (*inputs.LABEL_MAP.values(), "EQUIVALENT　")])
    turns = inputs.table(spark, sf_dir, "conversations")
    label = F.get(labels, F.pmod(F.length("text"), F.lit(4)))
    return turns.select("conv_id", "turn", scores.normalize_label(label).alias("label"))


def probability_checks(spark, sf_dir):
    """Error class of probability rows built from event values, sound and unsound."""
    value = F.col("value") / 1000
    lacking = F.when(F.col("event_type") == "purchase", F.lit(None).cast("double"))
    third = F.coalesce(lacking, F.lit(1.0) - value)
    rows = F.when(F.col("event_type") == "click", F.array(value, third)).when(
        F.col("event_type") == "purchase", F.array(value, value, third)
    ).otherwise(F.array(value, F.lit(0.0), third))
    events = inputs.table(spark, sf_dir, "events")
    return events.select("event_id", scores.probability_error(rows).alias("problem"))


def scored_pairs(spark, sf_dir):
    """All pairs with predictions: from the earlier cache where it has them."""
    def predicted(run: Run) -> DataFrame:
        missing = scoring.missing_pairs(run.narrow, run.known, run.texts)
        fresh = stage(scored(missing), path=f"{run.folder}/fresh")
        return scoring.predicted_pairs(run.narrow, run.known.unionByName(fresh))

    stored = flagged_texts(spark, sf_dir)
    rows = kept(spark, "predicted", (predicted(run) for run in two_runs(stored)))
    return _micros(scoring.spelled_scores(rows, stored))


def attached_predictions(spark, sf_dir):
    """Pairs of the earlier run's texts, joined to its cache."""
    stored = unique_stored(spark, sf_dir, ended=True)
    narrow = scoring.narrow_pairs(paired(stored))
    return _micros(scoring.attach_predictions(narrow, earlier_cache(spark, sf_dir), stored))


def scoring_totals(spark, sf_dir):
    """Pairs written, and pairs that had to be scored."""
    total = scored_anew = 0
    for run in two_runs(flagged_texts(spark, sf_dir)):
        total += run.narrow.count()
        scored_anew += scoring.missing_pairs(run.narrow, run.known, run.texts).count()
    return spark.createDataFrame([(total, scored_anew)], "total_pairs long, scored_pairs long")


# -- prompts and names --------------------------------------------------------

def identification_prompts(spark, sf_dir):
    rows = inputs.corpus(spark, sf_dir)
    return rows.select(
        "index",
        *[prompts.identification_prompt("src", style).alias(style) for style in ("default", "cot")],
        prompts.expected_answer("ambiguity").alias("expected_answer"),
    )


def comparison_prompts(spark, sf_dir):
    rows = evaluation.comparison_requests(inputs.sentence_pairs(spark, sf_dir), "cot")
    return rows.withColumn("direct", prompts.comparison_prompt("sentence_1", "sentence_2"))


def translation_prompts(spark, sf_dir):
    def render(content: Column) -> Column:
        return F.concat(F.lit("<user>\n"), content, F.lit("\n<assistant>\n"))

    rows = inputs.candidates(spark, sf_dir)
    return rows.select(
        "candidate_index", "model",
        prompts.translation_prompt("raw_text", "model_type", render).alias("prompt"),
    )


def model_names(spark, sf_dir):
    suffixes = F.array(*[F.lit(x) for x in inputs.MODEL_NAMES])
    rows = inputs.table(spark, sf_dir, "pages").select(
        "page_id", "url", F.posexplode(suffixes).alias("variant", "suffix")
    )
    model = F.concat("url", "suffix")
    return rows.select(
        "page_id", "variant",
        names.infer_model_type(model).alias("inferred"),
        names.resolve_model_type(model, F.lit(True)).alias("model_type"),
        names.model_tag(model).alias("tag"),
        names.report_name(model, thinking=True).alias("report"),
        names.model_slug(model).alias("slug"),
    )


# -- token-level evaluation ---------------------------------------------------

def vocabulary() -> Column:
    return F.array(*[F.lit(token) for token in inputs.VOCABULARY])


def parse_answer(spark, sf_dir):
    """Answers in documents (1 or 2) and in generated responses (是 or 否)."""
    docs = inputs.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"),
        text.parse_answer("text", prompts.COMPARISON_CHOICES).alias("answer"),
    )
    turns = inputs.generations(spark, sf_dir).select(
        F.lit("generations").alias("origin"), F.col("request_id").alias("id"),
        text.parse_answer("text", prompts.IDENTIFICATION_CHOICES).alias("answer"),
    )
    return docs.unionByName(turns)


def _position(mode: str) -> Column:
    return tokens.decision_position(
        "token_ids", "logprobs", mode, prompts.IDENTIFICATION_CHOICES, inputs.THINK_END,
        vocabulary(),
    )


def decision_position(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = inputs.generations(spark, sf_dir)
        return rows.select("request_id", _position(mode).alias("position"))

    return query


def last_subsequence(spark, sf_dir):
    start = tokens.last_subsequence("token_ids", inputs.THINK_END)
    return inputs.generations(spark, sf_dir).select("request_id", start.alias("start"))


def choice_probabilities(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = inputs.generations(spark, sf_dir).withColumn("position", _position(mode))
        shares = tokens.choice_probabilities(
            "logprobs", "position", prompts.IDENTIFICATION_CHOICES, vocabulary()
        )
        yes, no = prompts.IDENTIFICATION_CHOICES
        return rows.withColumn("p", shares).select(
            "request_id",
            micro(F.col("p.raw")[yes]).alias("raw_yes"),
            micro(F.col("p.raw")[no]).alias("raw_no"),
            micro(F.col("p.normalized")[yes]).alias("share_yes"),
            micro(F.col("p.normalized")[no]).alias("share_no"),
        )

    return query


def token_logprobs(spark, sf_dir):
    rows = inputs.generations(spark, sf_dir)
    records = tokens.token_records("token_ids", "logprobs", vocabulary())
    flat = rows.select("request_id", F.posexplode(records).alias("position", "t"))
    return flat.select(
        "request_id", "position", "t.token_id", "t.token",
        F.floor(F.col("t.sampled_logprob") * 1000 + 0.5).cast("bigint").alias("sampled_logprob"),
        F.array_join(F.col("t.top.token"), "|").alias("top_tokens"),
        F.size("t.top").cast("bigint").alias("n_top"),
    )


def decoded_tokens(spark, sf_dir):
    """Alternatives without a recorded text, decoded by the vocabulary."""
    rows = inputs.generations(spark, sf_dir)
    flat = rows.select("request_id", F.posexplode("logprobs").alias("position", "top"))
    flat = flat.select("request_id", "position", F.inline("top"))
    entries = spark.createDataFrame(
        list(enumerate(inputs.VOCABULARY)), "token_id int, token string"
    ).where("token_id <> 6")
    return decode_tokens(flat, entries).select("request_id", "position", "rank", "token")


def _report(df: DataFrame, choices) -> DataFrame:
    first, second = choices
    share = F.col("choice_probability.normalized")
    return df.select(
        *[name for name in df.columns if name != "choice_probability"],
        micro(share[first]).alias("share_first"),
        micro(share[second]).alias("share_second"),
    )


def identification_results(spark, sf_dir):
    found = evaluation.identification_results(
        inputs.corpus(spark, sf_dir), inputs.labelled_generations(spark, sf_dir), "cot",
        texts=vocabulary(),
    )
    return _report(found, prompts.IDENTIFICATION_CHOICES)


def comparison_results(spark, sf_dir):
    spelled = F.array(*[F.lit(token) for token in inputs.PAIR_VOCABULARY])
    found = evaluation.comparison_results(
        inputs.sentence_pairs(spark, sf_dir), inputs.pair_generations(spark, sf_dir), "cot",
        texts=spelled,
    )
    return _report(found, prompts.COMPARISON_CHOICES)


QUERIES: dict[str, Query] = {
    "clean_translation": clean_translation,
    "flatten_candidates": flatten_candidates,
    "carry_metadata": carry_metadata,
    "carried_candidates": carried_candidates,
    "record_checks": record_checks,
    "extract_status": extract_status,
    "extract_summary": extract_summary,
    "sampled_candidates": sampled_candidates,
    "batch_records": batch_records,
    "corpus_records": corpus_records,
    "label_checks": label_checks,
    "blank_preview": blank_preview,
    "source_consistency": source_consistency,
    "inconsistent_sources": inconsistent_sources,
    "duplicate_keys": duplicate_keys,
    "excluded_empties": excluded_empties,
    "unique_translations": unique_translations,
    "pair_count_estimate": pair_count_estimate,
    "source_groups": source_groups,
    "translation_pairs": translation_pairs,
    "pairs_per_source": pairs_per_source,
    "cache_keys": cache_keys,
    "cache_misses": cache_misses,
    "cache_hits": cache_hits,
    "cache_upsert": cache_upsert,
    "softmax_scores": softmax_scores,
    "label_scores": label_scores,
    "normalized_labels": normalized_labels,
    "probability_checks": probability_checks,
    "scored_pairs": scored_pairs,
    "attached_predictions": attached_predictions,
    "scoring_totals": scoring_totals,
    "identification_prompts": identification_prompts,
    "comparison_prompts": comparison_prompts,
    "translation_prompts": translation_prompts,
    "model_names": model_names,
    "parse_answer": parse_answer,
    "last_subsequence": last_subsequence,
    "decision_position_default": decision_position("default"),
    "decision_position_cot": decision_position("cot"),
    "decision_position_thinking": decision_position("thinking"),
    "choice_probabilities_default": choice_probabilities("default"),
    "choice_probabilities_cot": choice_probabilities("cot"),
    "choice_probabilities_thinking": choice_probabilities("thinking"),
    "token_logprobs": token_logprobs,
    "decoded_tokens": decoded_tokens,
    "identification_results": identification_results,
    "comparison_results": comparison_results,
    **STORED_QUERIES,
}
