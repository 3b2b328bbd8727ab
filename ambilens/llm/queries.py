"""Registered queries of this subpackage: one for each operator, and the pipeline's SQL.

Each runs its operator over whole tables and derives the columns that are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambilens.llm import (
    dual_tree, filter_audit, graph_search, identifiers, language, mixing, packing, pii, pitman_yor,
    quality_rules, shards, simhash, wand,
)
from ambilens.llm.common import crc32_mod
from ambilens.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with remainder 1 are held out of training."""
    docs = documents(spark, sf_dir)
    remainder = crc32_mod("doc_id", 3)
    model = language.train(docs.where(language.is_training(remainder)).select("text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op2_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie by source in 12 shards of very unequal size go to 16 equal ones:
    what the rewritten files hold."""
    docs = documents(spark, sf_dir)
    by_source = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(12))
    placed, _ = shards.reshard_files(docs, by_source)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op3_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return graph_search.search(embeddings, F.col("vec_id") % 20 == 0)


def op5_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents nearest by BM25 to the whole text of every 50th document."""
    found = wand.search(documents(spark, sf_dir), F.col("doc_id") % 50 == 0)
    return found.withColumn("score", F.round("score", 6))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.detect(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", *[_count("spans", kind) for kind in identifiers.KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir), columns=["doc_id"])
    found = found.withColumn("base", F.filter("pii_spans", lambda s: s["base"]))
    return found.select(
        "doc_id", *[_count("base", kind) for kind in pii.KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"),
    )


def op7_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(documents(spark, sf_dir), crc32_mod("doc_id", 5) == 1)


def op11_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document, cutoffs by language."""
    found = quality_rules.judge_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def op12_packed_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return dual_tree.rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_min_cost_resharding, op3_robust_pruned_graph, op4_markov_secrets,
        op5_block_max_wand, op6_weak_supervision_pii, op7_simhash_gray, op8_pareto_mixing,
        op9_shortest_pack_first, op10_pitman_yor, op11_certified_rules, op12_packed_filter_audit,
        op13_dual_tree_search,
    )
}

WORDS = r"string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[ \t\n\x0b\f\r]+')".format(
    upper="ABCDEFGHIJKLMNOPQRSTUVWXYZ", lower="abcdefghijklmnopqrstuvwxyz"
)

LLM_ORACLES: dict[str, str] = ORACLES | {
    "op5_block_max_wand": f"""
with words as (
  select doc_id, word, count(*) as tf
  from (select doc_id, unnest({WORDS}) as word from documents) where word <> '' group by all),
lengths as (select doc_id, sum(tf) as n from words group by all),
corpus as (
  select (select count(*) from documents) as n_docs,
         (select sum(n) from lengths) / (select count(*) from documents)::double as mean),
frequency as (select word, count(*) as df from words group by all),
scored as (
  select q.doc_id as query_id, d.doc_id,
         sum(q.tf * ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * d.tf * 2.2::double
             / (d.tf + 1.2::double * (0.25::double + 0.75::double * n / mean))) as score
  from words q join words d on q.word = d.word join frequency f on f.word = q.word
  join lengths l on l.doc_id = d.doc_id cross join corpus
  where q.doc_id % 50 = 0 and d.doc_id <> q.doc_id
  group by all),
ranked as (
  select *, row_number() over (partition by query_id order by round(score, 8) desc, doc_id) as rank
  from scored)
select query_id, cast(rank as int) as rank, doc_id, round(score, 6) as score
from ranked where rank <= 20""",
    "op8_pareto_mixing": f"""
with facts as (
  select doc_id, source, len(list_filter({WORDS}, lambda w: w <> '')) as size,
         (('0x' || substr(md5(concat_ws(':', cast(doc_id as varchar), text)), 1, 12))::bigint::double
          + 0.5::double) / 281474976710656::double as u
  from documents),
classed as (select *, case when size > 0 then length(bin(size)) else 0 end + 4 as class from facts),
sources as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source is null, encode(source)) - 1) % 3
           when 0 then 5 when 1 then 2 else 1 end as w
  from facts group by source),
filled as (
  select *, 3 * source_size as most,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3.0 * source_size / w
           rows between unbounded preceding and 1 preceding), 0))::double
         / (sum(w) over (order by 3.0 * source_size / w
           rows between current row and unbounded following))::double as share
  from sources),
shared as (select arg_min(share, 3.0 * source_size / w) as share from filled where share * w <= most),
targets as (
  select source, source_size, least(most::double, s.share * w) as target from filled cross join shared s),
classes as (
  select c.source, class, sum(size)::bigint as size, any_value(target) as target
  from classed c join targets t on t.source is not distinct from c.source group by 1, 2),
bounds as (
  select *, coalesce(sum(size) over (partition by source order by class desc
              rows between unbounded preceding and 1 preceding), 0)::bigint * 3 as stopped,
         sum(size * class) over (partition by source order by class desc
              rows between current row and unbounded following)::bigint as mass
  from classes),
rates as (
  select source, arg_max(c, class) as rate from (
    select *, case when mass > 0 then (target - stopped::double) / mass::double else 0 end as c from bounds)
  where c * class <= 3 * (1 + 1e-12::double) group by source),
expected as (
  select f.*, t.source_size, t.target, least(coalesce(rate, 3.0::double) * class, 3.0::double) as e
  from classed f join targets t on t.source is not distinct from f.source
  left join rates r on r.source is not distinct from f.source),
ranked as (
  select *, case when size > 0 then floor(e)::bigint else 0 end as whole,
         case when size > 0 and e > floor(e)
           then (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) end as odds
  from expected),
placed as (
  select *, odds / (1 + odds) as q, target - (sum(whole * size) over (partition by source))::double as owed
  from ranked),
summed as (
  select *, (sum(case when q is null then 0 else size end) over (
      partition by source order by q nulls last, doc_id, u rows unbounded preceding))::double - owed as past
  from placed)
select doc_id, size::bigint as size, source_size, target,
       ((whole + case when q is not null and (past <= 0 or (past < size and past < size - past)) then 1 else 0 end)
        * size)::bigint as taken
from summed""",
}
