"""Token-level functions over id arrays and log-probability entries.

``token_ids`` is ``array<int>``. ``logprobs`` holds one entry per position, an
``array<struct<token_id, token, logprob, ...>>``; the recorded ``token`` may be
null and is then looked up by id in ``texts``, an ``array<string>`` indexed by
token id (see :mod:`ambilens.operators.vocabulary`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ambilens.functions.text import as_column, let, strip

MODES = ("default", "cot", "thinking")


def decode_id(token_id: Column, texts: Column | None) -> Column:
    """Text of an id: vocabulary entry, else the id itself in digits."""
    digits = token_id.cast("string")
    return digits if texts is None else F.coalesce(F.get(texts, token_id), digits)


def decoded_token(recorded: Column, token_id: Column, texts: Column | None) -> Column:
    """Recorded token text, else the decoded id."""
    return F.coalesce(recorded, decode_id(token_id, texts))


def decode_ids(token_ids: Column | str, texts: Column | None) -> Column:
    return F.transform(as_column(token_ids), lambda i: decode_id(i, texts))


def last_subsequence(sequence: Column | str, wanted: Sequence[int]) -> Column:
    """Start (0-based) of the last occurrence of ``wanted``; null if there is none."""
    sequence = as_column(sequence)
    width = len(wanted)
    if not width:
        return F.lit(None).cast("int")
    target = F.array(*[F.lit(int(i)) for i in wanted])
    last_start = F.size(sequence) - width
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(last_start, F.lit(0))),
        lambda i: (F.get(sequence, i) == int(wanted[0]))
        & (F.slice(sequence, i + 1, F.lit(width)) == target),
    )
    return F.when(last_start >= 0, F.try_element_at(starts, F.lit(-1)))


def decision_position(
    token_ids: Column | str,
    logprobs: Column | str,
    mode: str,
    choices: Sequence[str],
    think_end_ids: Sequence[int] = (),
    texts: Column | None = None,
    spelled: Column | str | None = None,
) -> Column:
    """Position (0-based) of the token that carries the decision, else null.

    ``default``: the first token. ``cot``: the last token that is exactly a
    choice. ``thinking``: the first token after the last end-of-thinking ids
    whose text is not blank. ``spelled``, the text at each position, takes the place
    of ``texts`` where the vocabulary was joined.
    """
    ids, entries = as_column(token_ids), as_column(logprobs)

    def text_at(token_id: Column, position: Column) -> Column:
        return decode_id(token_id, texts) if spelled is None else F.get(as_column(spelled), position)

    if mode not in MODES:
        raise ValueError(f"Unknown mode {mode!r}; known: {', '.join(MODES)}")
    present = (F.size(ids) > 0) & (F.size(entries) > 0)
    if mode == "default":
        return F.when(present, F.lit(0))

    if mode == "thinking":
        def first_spoken(start: Column) -> Column:
            after = start + len(think_end_ids)
            spoken = F.filter(
                F.sequence(after, F.greatest(after, F.size(ids) - 1)),
                lambda i: strip(text_at(F.get(ids, i), i)) != "",
            )
            return F.try_element_at(spoken, F.lit(1))

        return F.when(present, let(last_subsequence(ids, think_end_ids), first_spoken))

    def spells(token: Column) -> Column:
        # Most tokens hold no choice at all: look before stripping.
        holds = F.contains(token, F.lit(choices[0]))
        for choice in choices[1:]:
            holds = holds | F.contains(token, F.lit(choice))
        return holds & strip(token).isin(list(choices))

    def spells_choice(token_id: Column, position: Column) -> Column:
        entry = F.get(entries, position)
        recorded = F.exists(entry, lambda alt: (alt["token_id"] == token_id)
                            & spells(decoded_token(alt["token"], token_id, texts)))
        listed = F.exists(entry, lambda alt: alt["token_id"] == token_id)
        unlisted = spells(text_at(token_id, position)) & ~F.coalesce(listed, F.lit(False))
        return F.coalesce(recorded, F.lit(False)) | unlisted

    chosen = F.filter(
        F.transform(ids, lambda token_id, i: F.when(spells_choice(token_id, i), i)),
        lambda i: i.isNotNull(),
    )
    return F.when(present, F.try_element_at(chosen, F.lit(-1)))


def choice_probabilities(
    logprobs: Column | str,
    position: Column | str,
    choices: Sequence[str],
    texts: Column | None = None,
) -> Column:
    """``struct<raw, normalized>`` maps from choice to probability.

    Spellings of one choice add up. Without a position every value is null; with
    one, a choice that no alternative spells has probability zero.
    """
    position = as_column(position)
    entries = F.get(as_column(logprobs), position)
    spelled = F.transform(
        F.coalesce(entries, F.array()),
        lambda alt: F.struct(
            strip(decoded_token(alt["token"], alt["token_id"], texts)).alias("choice"),
            F.exp(alt["logprob"]).alias("p"),
        ),
    )
    names = F.array(*[F.lit(choice) for choice in choices])

    def masses(alternatives: Column) -> Column:
        return F.transform(names, lambda name: F.aggregate(
            F.filter(alternatives, lambda alt: alt["choice"] == name),
            F.lit(0.0),
            lambda acc, alt: acc + alt["p"],
        ))

    def shares(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda acc, p: acc + p)
        normalized = let(total, lambda t: F.transform(
            raw, lambda p: F.when(t > 0, p / t).otherwise(0.0)
        ))
        return F.struct(
            F.map_from_arrays(names, raw).alias("raw"),
            F.map_from_arrays(names, normalized).alias("normalized"),
        )

    unknown = F.array(*[F.lit(None).cast("double") for _ in choices])
    found = let(let(spelled, masses), shares)
    nothing = F.struct(
        F.map_from_arrays(names, unknown).alias("raw"),
        F.map_from_arrays(names, unknown).alias("normalized"),
    )
    return F.when(position.isNull(), nothing).otherwise(found)


def entry_alternatives(entry: Column) -> Column:
    """A ``map<id, struct>`` entry as the array form the other functions read."""
    return F.transform(
        F.map_entries(entry),
        lambda e: F.struct(
            e["key"].alias("token_id"),
            e["value"]["decoded_token"].alias("token"),
            e["value"]["logprob"].cast("double").alias("logprob"),
            e["value"]["rank"].cast("int").alias("rank"),
        ),
    )


def token_records(
    token_ids: Column | str, logprobs: Column | str, texts: Column | None = None
) -> Column:
    """Per generated token: id, text, sampled log-probability, alternatives.

    Positions without an entry have no alternatives (null); alternatives without
    a usable log-probability are dropped. A sampled id outside the alternatives
    has a null log-probability.
    """
    ids, entries = as_column(token_ids), as_column(logprobs)

    def record(token_id: Column, position: Column) -> Column:
        kept = F.filter(
            F.get(entries, position), lambda alt: alt["logprob"].isNotNull()
        )
        top = F.transform(
            kept,
            lambda alt: F.struct(
                alt["token_id"].alias("token_id"),
                decoded_token(alt["token"], alt["token_id"], texts).alias("token"),
                alt["logprob"].alias("logprob"),
                alt["rank"].alias("rank"),
            ),
        )
        sampled = F.filter(kept, lambda alt: alt["token_id"] == token_id)
        return F.struct(
            token_id.alias("token_id"),
            decode_id(token_id, texts).alias("token"),
            F.try_element_at(sampled, F.lit(-1))["logprob"].alias("sampled_logprob"),
            F.when(F.size(top) > 0, top).alias("top"),
        )

    return F.transform(ids, record)


def candidate(
    text: Column | str,
    cumulative_logprob: Column | str,
    token_ids: Column | str,
    logprobs: Column | str,
    finish_reason: Column | str,
    stop_reason: Column | str,
    texts: Column | None = None,
) -> Column:
    """One completion as a candidate struct of the raw archive."""
    return F.struct(
        as_column(text).alias("text"),
        as_column(cumulative_logprob).cast("double").alias("cumulative_logprob"),
        as_column(token_ids).alias("token_ids"),
        token_records(token_ids, logprobs, texts).alias("tokens"),
        as_column(finish_reason).alias("finish_reason"),
        as_column(stop_reason).cast("string").alias("stop_reason"),
    )
