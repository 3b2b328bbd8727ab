"""Token decoding through a vocabulary table ``(token_id, token)``."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.operators.checks import InvalidInput
from ambilens.operators.skew import fits_broadcast, lookup_join

MAX_VOCABULARY = 1_000_000
_SLOTS = 256


def vocabulary_texts(vocabulary: DataFrame, max_rows: int = MAX_VOCABULARY) -> Column:
    """The vocabulary as one literal ``array<string>`` indexed by token id.

    A model's vocabulary does not grow with the data; its size is measured all the
    same. Beyond the bound, or with ids outside it, this raises: use
    :func:`spell_generations`, which joins.
    """
    vocabulary = vocabulary.select("token_id", "token")
    low, top = vocabulary.agg(F.min("token_id"), F.max("token_id")).first()
    if low is not None and (low < 0 or top >= max_rows) or not fits_broadcast(vocabulary, max_rows):
        raise InvalidInput(f"The vocabulary is larger than {max_rows} ids from 0; join it instead")
    texts: list[str | None] = [None] * (0 if top is None else int(top) + 1)
    for row in vocabulary.collect():
        texts[row["token_id"]] = row["token"]
    return F.from_json(F.lit(json.dumps(texts, ensure_ascii=False)), "array<string>")


def spell_generations(
    generations: DataFrame, vocabulary: DataFrame, key: Sequence[str], max_rows: int = MAX_VOCABULARY
) -> DataFrame:
    """Generations with every alternative's ``token`` filled in, and ``spelled``.

    ``spelled`` holds the text of each generated id. For vocabularies of any size: ids
    are joined, not looked up in a literal. ``key`` identifies a generation. Each id of a
    generation is joined once however often it occurs, and what it means comes back to
    the generation by ``key``; the tokens stay in their row. Of several texts of one id,
    the smallest counts.
    """
    key = list(key)
    recorded = F.transform(F.flatten(F.filter("logprobs", lambda entry: entry.isNotNull())), lambda a: a["token_id"])
    used = F.concat(F.coalesce("token_ids", F.array()), F.coalesce(recorded, F.array()))
    ids = generations.select(*key, F.explode(F.array_distinct(used)).alias("token_id")).where("token_id is not null")
    once = vocabulary.groupBy("token_id").agg(F.min("token").alias("token"))
    named = decode_tokens(ids, once, max_rows)
    slot = F.pmod(F.col("token_id"), F.lit(_SLOTS)).cast("int")
    listed = named.groupBy(*key).agg(F.collect_set(F.struct(slot.alias("slot"), "token_id", "token")).alias("__ids"))
    # A map is searched in order, so ids come in a map of maps, by their remainder.
    slots = F.array_distinct("__ids.slot")
    meant = F.map_from_arrays(slots, F.transform(slots, lambda s: F.map_from_entries(F.transform(
        F.filter("__ids", lambda i: i["slot"] == s), lambda i: F.struct(i["token_id"], i["token"])
    ))))
    joined = generations.join(listed.select(*key, meant.alias("__meant")), key, "left")

    def text(token_id: Column) -> Column:
        slot = F.pmod(token_id, F.lit(_SLOTS)).cast("int")
        return F.try_element_at(F.try_element_at(F.col("__meant"), slot), token_id)

    def filled(entry: Column) -> Column:
        return F.transform(entry, lambda a: a.withField("token", F.coalesce(a["token"], text(a["token_id"]))))

    unknown = F.col("__meant").isNull()
    return (
        joined.withColumn("__logprobs", F.when(unknown, F.col("logprobs")).otherwise(F.transform("logprobs", filled)))
        .withColumn("spelled", F.when(unknown, F.array()).otherwise(F.coalesce(F.transform("token_ids", text), F.array())))
        .withColumn("logprobs", F.col("__logprobs"))
        .drop("__logprobs", "__meant")
    )


def decode_tokens(
    tokens: DataFrame, vocabulary: DataFrame, max_rows: int = MAX_VOCABULARY
) -> DataFrame:
    """Add ``token`` to rows with a ``token_id``; a recorded ``token`` wins.

    One row per token. Frequent ids are spread by salt where the vocabulary is
    too large to broadcast.
    """
    entries = vocabulary.select("token_id", F.col("token").alias("__text"))
    joined = lookup_join(tokens, entries, ["token_id"], max_rows=max_rows)
    parts = [F.col("__text"), F.col("token_id").cast("string")]
    if "token" in tokens.columns:
        parts.insert(0, F.col("token"))
    return joined.withColumn("token", F.coalesce(*parts)).drop("__text")
