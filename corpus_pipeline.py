"""A training corpus from raw documents: the stages, in order, and their run.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of ``docs``; the last returns pieces placed in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambilens.llm import language, mixing, packing, pii, simhash
from ambilens.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts and texts without a letter.

    The classifier learns from the documents' own labels. Where lang is null, the
    predicted language is filled in; a given label stays.
    """
    model = language.train(docs.select("text", "lang"))
    columns = tuple(docs.columns)
    found = language.predict(docs, model, columns, ("__lang", "__score"))
    filled = F.coalesce(F.col("lang"), F.col("__lang")).alias("lang")
    return found.where(F.col("__lang") != language.UNDETERMINED).select(
        *[filled if c == "lang" else F.col(c) for c in columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each SimHash group.

    Rows without a doc_id can't be told apart by it and stay.
    """
    found = stage(simhash.groups(docs), "near-duplicates")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    repeated = stage(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    # One plan at every size: which ids go grows with the corpus, so it is never broadcast.
    if repeated.isEmpty():
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    kept = docs.join(gone.union(repeated).distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    # Rows that share a doc_id are decided one by one: the first by all columns stays in each group.
    rows = stage(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns), "repeated-rows")
    printed = simhash.fingerprints(rows.select(F.xxhash64("text").alias("doc_id"), "text").distinct())
    prints = printed.select(F.col("doc_id").alias("__text"), F.col("fp").alias("__fp")).distinct()
    first = found.where("doc_id = component_id").select(
        F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("component").alias("__group")
    ).distinct()
    number = F.row_number().over(Window.partitionBy("__group").orderBy(*docs.columns))
    once = (
        rows.withColumn("__text", F.xxhash64("text")).join(prints, "__text").withColumnRenamed("doc_id", "__id")
        .join(first, ["__id", "__fp"]).withColumnRenamed("__id", "doc_id").withColumn("__n", number)
    )
    return kept.unionByName(once.where("__n = 1").select(*docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind; no document goes.

    n_chars, where there is one, is that of the new text; a null one stays null.
    """
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", length)
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; none means the document goes."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as pieces of 2048-token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


LLM_QUERIES = {"pipeline": run}
LLM_ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
