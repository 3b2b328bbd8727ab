"""Personal data by weak supervision, DataFrame functions only.

Candidate spans come from patterns. Four labelers vote on each (1 personal, -1 not,
0 no opinion): the pattern's own checks, gazetteers, cue words before the span and the
characters around it. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal data.
These probabilities are the soft labels of the final span classifier, a naive Bayes
over span features. Spans that pass the base checks always stay; the classifier adds
others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambilens.session import stage

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and the conditions on where a match
# may begin don't change what is found; they keep long runs from being tried at each place.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms that the base patterns miss; what they find is only kept if the classifier says so.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
# A text without this can't match.
NEEDS = {"email": "@", "phone": "+"}

# Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz de fr es it uk eu us ca au nl ch at be se no dk fi pl pt br mx ar jp cn in ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 420 421".split()
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
LOCAL_NETWORKS = r"^(?:0|127|255|224)\."
# Cue words before a span.
CUES = "mail email e-mail contact contacto kontakt courriel correo phone tel telefon telefono telephone call fax mobile cell card visa credit carte tarjeta karte ip address adresse host".split()
COUNTER_CUES = "version v build isbn issn section figure order invoice item part rev release page no nr num id".split()

BUCKETS = 4096
CONTEXT = 32
#: Elements of an array, and characters of a text, that are worked on at a time.
BLOCK = 256
ROUNDS, SETTLED = 500, 1e-7
#: What a labeler's votes are expected to be on personal data and on other spans, in the
#: order of the labelers: where the estimates begin. It weighs as much as PRIOR_SPANS spans
#: of each class, so few spans can't turn a failed check digit into a sign of a card, and
#: many decide for themselves.
EXPECTED = (
    ({1: 0.98, -1: 0.02}, {1: 0.12, -1: 0.88}),
    ({1: 0.88, -1: 0.12}, {1: 0.38, -1: 0.62}),
    ({1: 0.80, -1: 0.20}, {1: 0.20, -1: 0.80}),
    ({1: 0.95, -1: 0.05}, {1: 0.63, -1: 0.37}),
)
PRIOR_SPANS = 10
THRESHOLD = 0.5

_SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas read it at each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` folded over each prefix of an array of ints that isn't empty, from 0 on.

    An array that grows element by element is copied each time, so prefixes are formed in
    blocks of BLOCK, which begin at the folds of the blocks before them.
    """
    def grown(state: Column, value: Column) -> Column:
        at = op(state.at, value).cast("int")
        return F.struct(at.alias("at"), F.concat(state.all, F.array(at)).alias("all"))

    def prefixes(block: Column, begin: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(block, F.struct(begin.cast("int").alias("at"), empty.alias("all")), grown, lambda s: s.all)

    def joined(blocks: Column) -> Column:
        folds = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: op(a, x).cast("int")))
        return _let(prefixes(folds, F.lit(0)), lambda ends: F.flatten(F.transform(
            blocks, lambda block, i: prefixes(block, F.when(i == 0, 0).otherwise(F.get(ends, i - 1)))
        )))

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    return _let(_let(values, cut), joined)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches with their place in code points and the text around them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        # The piece behind the last match has no partner.
        lengths = F.zip_with(m.pieces, m.found, lambda p, f: F.length(p) + F.coalesce(F.length(f), F.lit(0)))
        return _let(_running(lengths, lambda a, x: a + x), lambda ends: F.transform(m.found, lambda value, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(value)).alias("start"), F.get(ends, i).alias("end"),
            value.alias("value"), F.right(F.get(m.pieces, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(m.pieces, i + 1), F.lit(1)).alias("after"),
        )))

    none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    collected = _let(F.struct(found.alias("found"), pieces.alias("pieces")), placed)
    return F.when(F.size(found) > 0, collected).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") < 5, c.cast("int") * 2)
        .otherwise(c.cast("int") * 2 - 9),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


def valid(kind: Column, value: Column) -> Column:
    """The base checks of each kind."""
    digits = _digits(value)
    count = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(value, r"\."), _byte))
        .when(kind == "card", count.between(16, 19) & _luhn(digits))
        .otherwise(count.between(8, 15))
    )


def _one_of(value: Column, words: Sequence[str]) -> Column:
    return F.coalesce(value.isin(list(words)), F.lit(False))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _described(span: Column, base: bool) -> Column:
    """Span with its votes and the buckets of its features."""
    kind, value = span["kind"], span["value"]
    digits = _digits(value)
    domain = F.lower(F.element_at(F.split(value, r"\."), -1))
    words = F.regexp_extract_all(F.lower(span["before"]), F.lit(r"[\p{L}-]+"), F.lit(0))
    near = F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3)
    last = F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))
    edge = F.right(span["before"], F.lit(1))
    ok = F.lit(base) & valid(kind, value)
    checks = F.when(ok, 1).when(F.lit(base), -1).otherwise(0)
    gazetteer = (
        F.when(kind == "email", _vote(_one_of(domain, TOP_DOMAINS), F.lit(False)))
        .when(kind == "ip", _vote(~value.rlike(LOCAL_NETWORKS), value.rlike(LOCAL_NETWORKS)))
        .when(kind == "card", _vote(digits.rlike(CARD_ISSUERS), ~digits.rlike(CARD_ISSUERS)))
        .otherwise(_vote(
            value.startswith("+") & (_one_of(F.substring(digits, 1, 1), CALLING_CODES)
                                     | _one_of(F.substring(digits, 1, 2), CALLING_CODES)
                                     | _one_of(F.substring(digits, 1, 3), CALLING_CODES)),
            value.startswith("+"),
        ))
    )
    cues = _vote(
        F.exists(near, lambda w: _one_of(w, CUES)), F.exists(near, lambda w: _one_of(w, COUNTER_CUES))
    )
    joined = r"[\p{L}\p{N}_=/]"
    alone = _vote(~edge.rlike(joined) & ~span["after"].rlike(joined), F.lit(True))
    votes = F.concat_ws(",", *[v.cast("string") for v in (checks, gazetteer, cues, alone)])

    def feature(name: str, part: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), kind, part), F.lit(BUCKETS)).cast("int")

    shape = F.regexp_replace(F.regexp_replace(F.right(value, F.lit(24)), "[0-9]+", "0"), r"\p{L}+", "a")
    features = F.array(
        feature("kind", F.lit("")), feature("ok", ok.cast("string")), feature("shape", shape),
        feature("digits", F.length(digits).cast("string")), feature("last", last),
        feature("edge", F.regexp_replace(edge, r"[\p{L}\p{N}]", "a")),
        feature("after", F.regexp_replace(span["after"], r"[\p{L}\p{N}]", "a")),
        feature("gazetteer", gazetteer.cast("string")), feature("cues", cues.cast("string")),
    )
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        ok.alias("base"), votes.alias("votes"), features.alias("features"),
    )


def _describe(base: bool) -> Callable[[Column], Column]:
    return lambda span: _described(span, base)


def candidates(docs: DataFrame, name: str = "candidates") -> DataFrame:
    """``docs`` with an array column ``name`` of described spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind, pattern in patterns.items():
            spans = _spans(text, kind, pattern)
            if base and kind in NEEDS:
                none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
                spans = F.when(text.contains(NEEDS[kind]), spans).otherwise(none)
            found.append(F.transform(spans, _describe(base)))
    return docs.withColumn(name, F.concat(*found))


def fit_labelers(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Probability of being personal data for each (kind, votes), by EM.

    The latent class of a span decides each labeler's vote, independently; a labeler's
    reliabilities are shared by all kinds, the share of personal data is the kind's own.
    """
    kinds = sorted({k for k, _ in counts})
    votes = {key: tuple(map(int, key[1].split(","))) for key in counts}
    rate = [{+1: dict(yes), -1: dict(no)} for yes, no in EXPECTED]
    prior = dict.fromkeys(kinds, 0.5)
    posterior: dict[tuple[str, str], float] = {}
    for _ in range(ROUNDS):
        before, posterior = posterior, {}
        for key in counts:
            yes = math.log(prior[key[0]]) + sum(math.log(rate[i][+1][v]) for i, v in enumerate(votes[key]) if v)
            no = math.log(1 - prior[key[0]]) + sum(math.log(rate[i][-1][v]) for i, v in enumerate(votes[key]) if v)
            posterior[key] = 1 / (1 + math.exp(min(700.0, no - yes)))
        if before and max(abs(posterior[key] - before[key]) for key in counts) < SETTLED:
            break
        for kind in kinds:
            own = [key for key in counts if key[0] == kind]
            n = sum(counts[key] for key in own)
            prior[kind] = (1 + sum(counts[key] * posterior[key] for key in own)) / (2 + n)
        rate = reliabilities(counts, posterior, PRIOR_SPANS)
    # The classes have no names of their own: personal is what most labelers vote for.
    agree = sum(1 if one[+1][1] > one[-1][1] else -1 for one in rate)
    return posterior if agree >= 0 else {key: 1 - p for key, p in posterior.items()}


def reliabilities(
    counts: dict[tuple[str, str], int], posterior: dict[tuple[str, str], float], prior_spans: float = 0
) -> list[dict[int, dict[int, float]]]:
    """Share of each labeler's votes for and against, on personal data (1) and on other spans (-1).

    A labeler without opinion says nothing about a span: the loose patterns, say, have no
    checks of their own, and that makes them neither right nor wrong.
    """
    rates = []
    for i, expected in enumerate(EXPECTED):
        sides = {}
        for side in (+1, -1):
            mass = {v: prior_spans * r for v, r in expected[0 if side > 0 else 1].items()}
            for key, n in counts.items():
                if vote := int(key[1].split(",")[i]):
                    mass[vote] += n * (posterior[key] if side > 0 else 1 - posterior[key])
            total = sum(mass.values()) or 1
            sides[side] = {v: m / total for v, m in mass.items()}
        rates.append(sides)
    return rates


def fit(found: DataFrame, name: str = "candidates") -> list[float]:
    """Weight of each feature bucket; the classifier's log-odds are the sum over a span.

    What reaches the driver is bounded: vote patterns (at most 4 * 81) and feature
    buckets (BUCKETS).
    """
    spans = found.select(F.explode(name).alias("s")).select("s.*")
    counts = {(r.kind, r.votes): r["count"] for r in spans.groupBy("kind", "votes").count().collect()}
    if not counts:
        return [0.0] * BUCKETS
    posterior = fit_labelers(counts)
    soft = F.create_map(*[F.lit(x) for key, p in posterior.items() for x in ("|".join(key), p)])
    p = F.element_at(soft, F.concat_ws("|", "kind", "votes"))
    sums = (
        spans.select(p.alias("p"), F.explode("features").alias("bucket"))
        .groupBy("bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    )
    total_yes = sum(counts[k] * posterior[k] for k in counts)
    total_no = sum(counts.values()) - total_yes
    weights = [0.0] * BUCKETS
    for row in sums:
        weights[row.bucket] = math.log((row.yes + 0.5) / (total_yes + 1)) - math.log((row.no + 0.5) / (total_no + 1))
    # The class shares count once: each span has exactly one "kind" feature to carry them.
    offset = math.log((total_yes + 0.5) / (total_no + 0.5))
    return [round(w, 9) for w in weights] + [round(offset, 9)]


def _free(spans: Column) -> Column:
    """Spans that aren't base ones and that no base span overlaps."""
    # A base span overlaps if it begins before the span's end and ends behind its start: in
    # this order, the farthest end of all base spans up to the span tells.
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.when(s["base"], s["start"]).otherwise(s["end"] - 1).alias("at"), (~s["base"]).alias("loose"), s.alias("s")
    )))
    return _let(ordered, lambda all_: _let(
        _running(F.transform(all_, lambda e: F.when(e["loose"], 0).otherwise(e["s"]["end"])), F.greatest),
        lambda reach: F.transform(
            F.filter(all_, lambda e, i: e["loose"] & (F.get(reach, i) <= e["s"]["start"])), lambda e: e["s"]
        ),
    ))


def detect(docs: DataFrame, name: str = "pii_spans", columns: Sequence[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, if None) with an array column of spans ``kind, start, end, base, score``.

    Starts are code points, ends exclusive. Spans that pass the base checks have base
    true and always stay; others stay with a score over THRESHOLD where no base span
    overlaps them. Null and empty texts have no spans; columns of ``docs`` stay as they
    are, but for one that is called ``name``. An empty table trains a model that adds
    nothing. Spans are in the order of KINDS, then start.
    """
    kept = list(docs.columns if columns is None else columns)
    found = stage(candidates(docs, name).select(*[c for c in kept if c != name], name), "pii")
    weights = fit(found, name)
    offset = weights[BUCKETS] if len(weights) > BUCKETS else 0.0
    table = F.from_json(F.lit(json.dumps(weights[:BUCKETS])), "array<double>")

    def scored(span: Column) -> Column:
        odds = F.aggregate(span["features"], F.lit(offset), lambda a, f: a + F.get(table, f))
        score = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))
        return F.struct(
            span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            span["base"].alias("base"), score.alias("score"),
        )

    base = F.filter(name, lambda s: s["base"])
    free = F.when(F.exists(name, lambda s: ~s["base"]), _let(F.col(name), _free)).otherwise(F.filter(name, lambda s: ~s["base"]))
    more = F.filter(F.transform(free, scored), lambda s: s["score"] > THRESHOLD)
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = F.transform(
        F.array_sort(F.transform(
            F.concat(F.transform(base, scored), more),
            lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s.alias("s")),
        )), lambda x: x["s"],
    )
    return found.withColumn(name, ordered)


def _stretches(spans: Column) -> Column:
    """Spans of one text joined where they overlap: ``start, end, label`` in order, by the first span."""
    def joined(ordered: Column, reach: Column) -> Column:
        first = F.filter(
            F.transform(ordered, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["kind"].alias("kind"))),
            lambda s: (s["i"] == 0) | (s["start"] >= F.get(reach, s["i"] - 1)),
        )
        return _let(first, lambda all_: F.transform(all_, lambda s, k: F.struct(
            s["start"].alias("start"),
            F.get(reach, F.coalesce(F.get(all_, k + 1)["i"], F.size(reach)) - 1).alias("end"),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"),
        )))

    by_start = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s.alias("s")))), lambda x: x["s"]
    )
    return _let(by_start, lambda ordered: _let(
        _running(F.transform(ordered, lambda s: s["end"]), F.greatest), lambda reach: joined(ordered, reach)
    ))


def _replaced(text: Column, spans: Column) -> Column:
    """Text with its spans replaced, block by block, so that no place is sought from the start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))

    def firsts(blocks: Column, stretches: Column) -> Column:
        """How many stretches begin before each block, and before the end."""
        borders = F.transform(F.sequence(F.lit(0), F.size(blocks)), lambda b: F.struct(
            (b * BLOCK).alias("at"), F.lit(False).alias("inside"), b.alias("block")
        ))
        places = F.transform(stretches, lambda s: F.struct(s["start"].alias("at"), F.lit(True).alias("inside"), F.lit(0).alias("block")))
        events = F.transform(
            F.array_sort(F.concat(borders, places)),
            lambda e, i: F.struct(e["inside"].alias("inside"), (i - e["block"]).alias("before")),
        )
        return F.transform(F.filter(events, lambda e: ~e["inside"]), lambda e: e["before"])

    def block_text(block: Column, b: Column, stretches: Column, before: Column) -> Column:
        begin, low, high = b * BLOCK, F.get(before, b), F.get(before, b + 1)
        own = F.slice(stretches, low + 1, high - low)

        def part(s: Column, k: Column) -> Column:
            since = F.greatest(F.when(low + k > 0, F.get(stretches, low + k - 1)["end"]).otherwise(0), begin)
            return F.concat(F.substring(block, since - begin + 1, s["start"] - since), s["label"])

        last = F.when(high > 0, F.get(stretches, high - 1)["end"]).otherwise(0)
        rest = F.substring(block, F.greatest(last - begin, F.lit(0)) + 1, F.lit(BLOCK))
        return F.concat(F.array_join(F.transform(own, part), ""), rest)

    return _let(F.struct(blocks.alias("blocks"), _stretches(spans).alias("stretches")), lambda t: _let(
        firsts(t["blocks"], t["stretches"]),
        lambda before: F.array_join(F.transform(
            t["blocks"], lambda block, b: block_text(block, b, t["stretches"], before)
        ), ""),
    ))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets.

    Of overlapping spans, the first by start names the whole stretch. Null texts stay null;
    all other columns stay as they are, whatever their names.
    """
    name = "__pii"
    while name in docs.columns:
        name += "_"
    text = F.col("text")
    masked = F.when(F.size(name) > 0, _replaced(text, F.col(name))).otherwise(text)
    return detect(docs, name).withColumn("text", masked).drop(name)
