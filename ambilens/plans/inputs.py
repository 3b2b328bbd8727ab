"""Inputs of the registered queries, derived row by row from the given tables.

Whole tables and whole texts; nothing here joins or groups beyond what a query is
about. ``oracles.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = (("org/Alpha-7B-Base", "base"), ("org/Alpha-7B-Instruct", "instruct"))
MODEL, REVISION = "org/pair-scorer", "r1"

# A ten-token vocabulary; the last two ids together end the thinking part.
VOCABULARY = ("是", "否", " ", "。", "的", " 是", "我", "否 ", "</", "think>")
THINK_END = (8, 9)
# The same ids spelling the answers of the comparison task.
PAIR_VOCABULARY = ("1", "2", " ", "。", "的", " 1", "我", "2 ", "</", "think>")

MODEL_NAMES = (
    "/Qwen3-8B", "/Qwen3-8B-Base/", "/qwen2.5-7B", "/Qwen2.5-7B-Instruct", "//", "-Chat.v1",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a candidate of two models, for its source.

    The second model decorates the text by language, so that each cleanup rule
    meets its case and cleaning makes duplicates across models.
    """
    docs = table(spark, sf_dir, "documents")
    text, lang = F.col("text"), F.col("lang")
    decorated = (
        F.when(F.col("n_chars") < 300, "   ")
        .when(lang == "en", F.concat(text, F.lit('"')))
        .when(lang == "fr", F.concat(text, F.lit('\ntail "x"')))
        .when(lang == "de", F.concat(text, F.lit(" Note: literal")))
        .otherwise(F.concat(F.lit("　 "), text, F.lit('""')))
    )
    number = F.substring("source", 4, 20).cast("bigint")
    outputs = [
        F.struct(F.lit(name).alias("model"), F.lit(kind).alias("model_type"), raw.alias("raw_text"))
        for (name, kind), raw in zip(MODELS, (text, decorated))
    ]
    return docs.select(
        number.alias("source_index"),
        (number + 2).alias("row_number"),
        F.col("source").alias("source_text"),
        (number >= 10).cast("tinyint").alias("ambiguity"),
        F.col("doc_id").cast("int").alias("candidate_index"),
        F.when(lang == "es", F.lit(None)).when(F.col("n_chars") > 2000, "length")
        .otherwise("stop").alias("finish_reason"),
        F.inline(F.array(*outputs)),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: a document is a batch with one sample, its lines the candidates."""
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            line.alias("text"),
            F.when(F.col("n_chars") > 2000, "length").alias("finish_reason"),
        ),
    )
    sample = F.struct(
        F.col("doc_id").alias("index"),
        (F.col("doc_id") + 2).alias("row_number"),
        F.col("source").alias("src"),
        (F.col("lang") == "en").cast("tinyint").alias("ambiguity"),
        lines.alias("candidates"),
    )
    config = F.struct(
        F.concat(F.lit("org/"), F.col("lang")).alias("model"),
        F.lit(None).cast("string").alias("model_type"),
    )
    return docs.select(
        F.col("source").alias("path"),
        F.col("doc_id").alias("seq"),
        F.lit("batch").alias("type"),
        config.alias("config"),
        F.array(sample).alias("samples"),
    )


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a conversation: system turns are metadata, the others batches."""
    turns = table(spark, sf_dir, "conversations")
    role = F.col("role")
    config = F.struct(F.col("text").alias("model"), F.lit("instruct").alias("model_type"))
    sample = F.struct(
        F.col("turn").alias("index"),
        F.array(F.struct(F.col("text").alias("text"))).alias("candidates"),
    )
    return turns.select(
        F.col("conv_id").cast("string").alias("path"),
        F.col("turn").alias("seq"),
        F.when(role == "system", "metadata").otherwise("batch").alias("type"),
        F.when(role == "system", config).alias("config"),
        F.when(role != "system", F.array(sample)).alias("samples"),
    )


def corpus_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: ``doc_id, src, ambiguity``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("ambiguity"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("src"))
    return labels.join(docs, "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the document id as index."""
    return corpus_source(spark, sf_dir).withColumnRenamed("doc_id", "index")


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text with the one after it."""
    items = table(spark, sf_dir, "benchmark")
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("unambiguous"))
    return items.withColumnRenamed("text", "ambiguous").join(following, "item_id").select(
        F.col("item_id").alias("pair_index"), "ambiguous", "unambiguous"
    )


def _generated(
    df: DataFrame, text: str, keep: list[str], shift: Column | None, vocabulary=VOCABULARY
) -> DataFrame:
    """Turn texts into token sequences: one token per word, its id from its length.

    Every position has one to three alternatives; no token text is recorded for
    the second, and a position may have no choice among them.
    """
    ids = F.transform(F.split(text, " "), lambda w: F.pmod(F.length(w), F.lit(10)))
    spelled = F.array(*[F.lit(token) for token in vocabulary])
    listed = F.array(*[_alternatives(i, vocabulary) for i in range(len(vocabulary))])

    def shifted(alternatives: Column) -> Column:
        return F.transform(alternatives, lambda alt: alt.withField(
            "logprob", alt["logprob"] - shift * 0.125
        ))

    entries = F.transform("token_ids", lambda i: F.get(listed, i))
    if shift is not None:
        entries = F.transform(entries, shifted)
    return df.withColumn("token_ids", ids).select(
        *keep,
        F.array_join(F.transform("token_ids", lambda i: F.get(spelled, i)), "").alias("text"),
        "token_ids",
        entries.alias("logprobs"),
    )


def _alternatives(token_id: int, vocabulary) -> Column:
    ids = [(token_id + 3 * k) % 10 for k in range(1 + token_id % 3)]
    return F.array(*[
        F.struct(
            F.lit(i).alias("token_id"),
            F.lit(None if k == 1 else vocabulary[i]).cast("string").alias("token"),
            F.lit(-0.25 * (k + 1)).alias("logprob"),
            F.lit(k + 1).alias("rank"),
        )
        for k, i in enumerate(ids)
    ])


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation per conversation turn, keyed by ``request_id``."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "request_id", F.col("conv_id") * 100 + F.col("turn")
    )
    return _generated(turns, "text", ["request_id"], F.col("turn").cast("double"))


def labelled_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generations of labelled documents: one per corpus row."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"))
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "index")
    return _generated(docs.join(labels, "index", "left_semi"), "text", ["index"], None)


def pair_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations per sentence pair, keyed by ``pair_index, order``."""
    items = sentence_pairs(spark, sf_dir).select(
        "pair_index", F.col("ambiguous").alias("text"),
        F.explode(F.array(F.lit("original"), F.lit("reversed"))).alias("order"),
    )
    # The reversed order starts one word later, so the two answers differ.
    later = F.when(F.col("order") == "original", F.col("text")).otherwise(
        F.concat(F.lit("a "), F.col("text"))
    )
    return _generated(
        items.withColumn("text", later), "text", ["pair_index", "order"], None,
        PAIR_VOCABULARY,
    )


def pair_logits(sentence1: Column, sentence2: Column) -> Column:
    """Stand-in classifier output, from text lengths."""
    one, two = F.length(sentence1), F.length(sentence2)
    return F.array(
        F.pmod(one, F.lit(7)) * 0.5, F.pmod(two, F.lit(5)) * 0.5, F.pmod(one + two, F.lit(3)) * 0.5
    )


LABEL_MAP = {0: "Entailment", 1: "not_equivalent", 2: " contradiction"}
