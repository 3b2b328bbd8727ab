"""Mixing sources to target weights: Pareto order sampling, DataFrame functions only.

Each document gets an expected number of copies. Whole copies are certain; the
fractional part is an inclusion probability p. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u a uniform number from a hash of the document, and a
source takes documents in that order until the words it still owes are reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambilens.llm.common import rank_within
from ambilens.operators.ordinals import with_ordinal
from ambilens.operators.skew import lookup_join
from ambilens.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Steps of the ranking by which a source's crossing point is first located.
BUCKETS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Add ``target`` to a stored table (source, source_size) of one row per source.

    Sources in code-point order, null last, take the weights in turn and share the
    total size. A target stops at ``max_copies`` times the source's size; the excess
    is shared again by weight until no target is above. Each round is one aggregate
    over the sources, so their number isn't bounded by a task.
    """
    known = with_ordinal(sources.where("source is not null"), ["source"], "__at")
    unknown = sources.where("source is null").withColumn(
        "__at", F.lit(sources.where("source is not null").count())
    )
    turn = F.pmod(F.col("__at"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    table = stage(
        known.unionByName(unknown).select(
            "source", "source_size", weight.cast("long").alias("__w"),
            (F.col("source_size") * max_copies).alias("__most"),
        ), "mix-sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, above = 0.0, None
    while True:
        stopped = F.col("__most") < F.lit(share) * F.col("__w")
        found = table.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("__most"))), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(~stopped, F.col("__w"))), F.lit(0)).alias("open"),
        ).first()
        if above == found.open or not found.open:
            break
        above = found.open
        share = (total - found.kept) / found.open
    return table.select(
        "source", "source_size",
        F.least(F.col("__most").cast("double"), F.lit(share) * F.col("__w")).alias("target"),
    )


def _facts(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``docs`` with what decides a row's copies: size, class and number u."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    return (
        docs.withColumn("__size", word_count()).withColumn("__md5", digest)
        .select(
            *columns, "__size", _key("source").alias("__key"),
            F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"),
            (F.when(F.col("__size") > 0, F.length(F.bin("__size"))).otherwise(0) + 4).alias("__class"),
            ((F.conv(F.substring("__md5", 1, 12), 16, 10).cast("long").cast("double") + 0.5)
             / float(1 << 48)).alias("__u"),
        )
    )


def _decided(facts: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """Join the row of the source and add ``__whole``, ``__q`` (null: not ranked), ``__b``."""
    joined = lookup_join(facts, sources, ["__key"], how="inner", spread=["__id", "__u"])
    expected = joined.withColumn("__e", F.least(F.col("__rate") * F.col("__class"), F.lit(float(max_copies))))
    part = F.col("__e") - F.floor(F.col("__e"))
    odds = (F.col("__u") / (1 - F.col("__u"))) / (part / (1 - part))
    some = F.col("__size") > 0
    return (
        expected.withColumn("__whole", F.when(some, F.floor(F.col("__e")).cast("long")).otherwise(0))
        .withColumn("__q", F.when(some & (part > 0), odds / (1 + odds)))
        .withColumn("__b", F.least((F.col("__q") * BUCKETS).cast("int"), F.lit(BUCKETS - 1)))
    )


def _cutoffs(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the place in the ranking up to which a source takes one more copy.

    ``__cut`` is the bucket where the owed words are reached (null: all are taken) and
    ``__last`` the last row taken in it (null: none). Of the ``__rows`` rows equal to it,
    ``__taken`` are taken.
    """
    buckets = ranked.groupBy("__key", F.coalesce("__b", F.lit(BUCKETS)).alias("__b")).agg(
        F.sum(F.when(F.col("__q").isNotNull(), F.col("__size")).otherwise(0)).alias("__words"),
        F.sum(F.col("__whole") * F.col("__size")).alias("__sure"), F.first("target").alias("target"),
    )
    # At most BUCKETS + 1 rows a source.
    own = Window.partitionBy("__key")
    upto = own.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = stage(
        buckets.withColumn("__owed", F.col("target") - F.sum("__sure").over(own))
        .withColumn("__end", F.sum("__words").over(upto))
        .withColumn("__start", F.col("__end") - F.col("__words"))
        .where((F.col("__b") < BUCKETS) & (F.col("__start") <= F.col("__owed")) & (F.col("__owed") < F.col("__end")))
        .select("__key", "__b", "__owed", "__start"), "mix-cut",
    )
    # Only rows of the crossing buckets are put in order: 1 in BUCKETS of a source, and
    # equal rows are one by then.
    order = ["__q", "__id", "__u"]
    inside = Window.partitionBy("__key", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    equal = (
        ranked.where("__q is not null").join(cut, ["__key", "__b"])
        .groupBy("__key", "__b", *order, "__owed", "__start", "__size").agg(F.count("*").alias("__rows"))
    )
    before = F.col("__start") + F.coalesce(F.sum(F.col("__size") * F.col("__rows")).over(inside), F.lit(0))
    # The row that crosses is taken if that ends nearer to what is owed.
    rest = F.col("__left") - F.col("__fit") * F.col("__size")
    taken = (
        equal.withColumn("__left", F.col("__owed") - before)
        .withColumn("__fit", F.floor(F.col("__left") / F.col("__size")))
        .withColumn("__taken", F.least("__rows", F.col("__fit") + (F.col("__size") - rest < rest).cast("long")))
        .where("__taken > 0")
    )
    last = taken.groupBy("__key").agg(F.max(F.struct(*order, "__taken", "__rows")).alias("__end"))
    ended = last.select(
        "__key", F.struct(*[F.col(f"__end.{c}") for c in order]).alias("__last"),
        F.col("__end.__taken").alias("__taken"), F.col("__end.__rows").alias("__rows"),
    )
    return (
        sources.join(cut.select("__key", F.col("__b").alias("__cut")), "__key", "left")
        .join(ended, "__key", "left")
    )


def _prepared(docs: DataFrame, columns: Sequence[str], weights: Sequence[int], max_copies: int) -> tuple[DataFrame, DataFrame]:
    """Stored facts of the rows, and one row per source with its rate and cutoff."""
    facts = stage(_facts(docs, columns), "mix-facts")
    # At most 64 rows a source: the classes are numbers of bits.
    classes = stage(
        facts.groupBy("__key", "__class").agg(F.sum("__size").alias("__size"), F.first("source").alias("source")),
        "mix-classes",
    )
    sources = stage(
        classes.groupBy("__key").agg(F.first("source").alias("source"), F.sum("__size").alias("source_size"))
        .drop("__key"), "mix-sizes",
    )
    rates = stage(_rates(classes, source_targets(sources, weights, max_copies), max_copies), "mix-rates")
    ranked = stage(_decided(facts.drop("source"), rates, max_copies), "mix-ranked")
    return ranked, stage(_cutoffs(ranked, rates), "mix-cutoffs")


def _with_copies(rows: DataFrame) -> DataFrame:
    """Add ``__copies``. Of equal rows where a source ends, the first so many are taken.

    Which of them are first doesn't matter, so they are numbered by where they lie.
    """
    here = F.struct("__q", "__id", "__u")
    partial = F.coalesce((here == F.col("__last")) & (F.col("__taken") < F.col("__rows")), F.lit(False))
    more = F.col("__cut").isNull() | (F.col("__b") < F.col("__cut")) | (
        (F.col("__b") == F.col("__cut"))
        & F.coalesce((here < F.col("__last")) | ((here == F.col("__last")) & (F.col("__nth") < F.col("__taken"))), F.lit(False))
    )
    edge = stage(rows.where(partial), "mix-edge")
    numbered = rank_within(edge, ["__key"], ["__id"], "__nth").select(*rows.columns, "__nth")
    return rows.where(~partial).withColumn("__nth", F.lit(0).cast("long")).unionByName(numbered).withColumn(
        "__copies", F.col("__whole") + (F.col("__q").isNotNull() & F.coalesce(more, F.lit(False))).cast("long")
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of each document.

    Documents need doc_id, text and source; other columns are ignored. The expected
    copies of a document grow with its length, by 4 + the bits of its word count, so
    that inclusion is unequal within a source, and are at most ``max_copies``. Null
    texts and texts without words have size 0 and no copy. Null sources are one
    source. Rows with the same doc_id and text share a rank; where a source ends among
    them, so many of them are taken as fit. An empty table gives an empty one.
    """
    ranked, sources = _prepared(docs, ["doc_id", "source"], weights, max_copies)
    cutoffs = sources.select("__key", "__cut", "__last", "__taken", "__rows")
    rows = lookup_join(ranked, cutoffs, ["__key"], how="inner", spread=["__id", "__u"])
    return _with_copies(rows).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target",
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def repeat(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Rows of ``docs``, each as often as :func:`mix` takes it (not at all, once or more).

    Whether a row is taken follows from the row and its source's cutoff, so texts are
    not shuffled.
    """
    _, sources = _prepared(docs, ["doc_id", "source"], weights, max_copies)
    rows = _decided(_facts(docs, docs.columns), sources.drop("source", "source_size", "target"), max_copies)
    copies = F.array_repeat(F.lit(0), F.col("__copies").cast("int"))
    return _with_copies(rows).select(*docs.columns, F.explode(copies).alias("__copy")).drop("__copy")


def _key(source: str) -> Column:
    """A source as a join key that tells null from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def _rates(classes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Per source the rate c for which copies min(max_copies, c * class) give the target.

    With classes from the largest down, those before the first class k where
    c(k) * k <= max_copies are at the limit, and c(k) shares what is left.
    """
    top = Window.partitionBy("__key").orderBy(F.desc("__class")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("__key").orderBy(F.desc("__class")).rowsBetween(0, Window.unboundedFollowing)
    keyed = classes.drop("source")
    cut = (
        keyed.join(targets.withColumn("__key", _key("source")), "__key")
        .withColumn("__limit", F.coalesce(F.sum("__size").over(top), F.lit(0)) * max_copies)
        .withColumn("__mass", F.sum(F.col("__size") * F.col("__class")).over(rest))
        .withColumn("__c", F.when(F.col("__mass") > 0, (F.col("target") - F.col("__limit")) / F.col("__mass")).otherwise(0.0))
        .where((F.col("__c") * F.col("__class") <= max_copies * (1 + 1e-12)))
    )
    # The first class that fits has the largest number; where none does, all are at the limit.
    best = cut.groupBy("__key").agg(F.max_by("__c", "__class").alias("__rate"))
    return targets.withColumn("__key", _key("source")).join(best, "__key", "left").select(
        "__key", "source_size", "target", F.coalesce("__rate", F.lit(float(max_copies))).alias("__rate")
    )
