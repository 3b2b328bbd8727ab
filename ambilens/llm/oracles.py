"""SQL for registered queries of this subpackage, as DuckDB reads it."""

from __future__ import annotations

from ambilens.llm.quality_rules import ERROR, LIMIT, LOSS, MOSTLY, RULES

_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


def _allowed(sizes: str, limit: float, error: str) -> str:
    """``n, most``: the largest k with P(Binomial(n, limit) <= k) <= error, -1 if none, by distinct n."""
    return f"""
    select n, coalesce(max(k) filter (where below <= {error}), -1) as most from (
      select n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({limit!r}::double)
          + (n - k) * ln(1 - {limit!r}::double))) over (partition by n order by k) as below
      from (select n::double as n, unnest(range(0, ceil(n * {limit!r})::bigint + 1))::double as k
            from (select distinct n from {sizes}) where n > 0)) group by n"""


#: Of each rule, in order: how bad a text of n words looks, 0 to 1000.
_EXTENTS = """1000 - least(n, 1000), 1000 - least(50 * chars // n, 1000), least(20 * chars // n, 1000),
    1000 * symbols // chars, 1000 * dups // n_lines, 1000 * repeats // n,
    1000 * others // chars, 1000 - 1000 * n_distinct // n, 1000 * capitals // chars"""

_MEASURES = rf"""
texts as (select doc_id, lang, coalesce(text, '') as text, {_SPLIT} as words from documents),
windows as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as run
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from texts)),
covered as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest(range(i, i + 8)) as j from (
      select doc_id, i, count(*) over (partition by doc_id, run) as times from windows) where times > 1)
  group by doc_id),
raw as (
  select t.doc_id, lang, text, len(words) as n, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as lines,
    coalesce(c.n, 0) as repeats, len(list_distinct(words)) as n_distinct,
    length(regexp_replace(text, '[^\x00-\x08\x0e-\x1f!-@\[-`{{-\x7f]', '', 'g')) as others,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as capitals
  from texts t left join covered c on c.doc_id = t.doc_id),
measured as (
  select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as dups,
    n < 20 or 100 * repeats > 30 * n as base_failed from raw)"""

_SHARE, _RULES = LIMIT / len(RULES), len(RULES)

_QUALITY = f"""
with {_MEASURES},
known as (select doc_id, max((quality = 1)::int) as good from labels where quality is not null group by doc_id),
extents as (select *, [{_EXTENTS}] as extent from measured where n > 0),
holdout as (
  select lang, text, max(good) as good, any_value(extent) as extent
  from extents join known using (doc_id) where not base_failed group by lang, text),
by_rule as (select lang, good, unnest(range(1, {_RULES + 1})) as rule, extent from holdout),
histogram as (
  select lang, rule, extent[rule] as e, sum(good)::bigint as good, sum(1 - good)::bigint as bad from by_rule group by all),
totals as (select lang, rule, sum(good)::bigint as n, sum(bad)::bigint as n_bad from histogram group by all),
error as (select {ERROR!r}::double / (greatest(count(distinct coalesce('=' || lang, '')), 1) * {_RULES}) as each from histogram),
spare as ({_allowed("totals", _SHARE, "(select each from error)")}),
cutoffs as (
  select t.lang, t.rule, c, n, n_bad, most,
    coalesce(sum(good) filter (where e >= c), 0)::bigint as lost, coalesce(sum(bad) filter (where e >= c), 0)::bigint as caught
  from totals t join (select unnest(range(1, 1002)) as c) on true
  join histogram h on h.lang is not distinct from t.lang and h.rule = t.rule
  join spare s using (n) where n_bad > 0 group by all),
useful as (
  select *, lost + caught as rejected, caught * n - {LOSS} * lost * n_bad as use from cutoffs
  where lost <= most and caught * n - {LOSS} * lost * n_bad > 0),
mostly as ({_allowed("(select rejected as n from useful)", MOSTLY, "(select each from error)")}),
lines as (
  select lang, rule, c, use, n, n_bad from (
    select u.*, row_number() over (partition by lang, rule order by use desc, c desc) as place
    from useful u join mostly m on m.n = rejected where lost <= m.most) where place = 1),
claims as (
  select lang, rule, n, n_bad, good from (
    select h.lang, rule, n, n_bad, good, row_number() over (partition by h.lang, h.text order by use desc, rule) as place
    from holdout h join lines l on l.lang is not distinct from h.lang and h.extent[rule] >= c) where place = 1),
own as (
  select lang, rule, sum(good)::bigint as lost, sum(1 - good)::bigint as caught, any_value(n) as n, any_value(n_bad) as n_bad
  from claims group by lang, rule),
worth as ({_allowed("(select lost + caught as n from own)", MOSTLY, "(select each from error)")}),
chosen as (
  select l.lang, l.rule, c from lines l join own o on o.lang is not distinct from l.lang and o.rule = l.rule
  join worth w on w.n = o.lost + o.caught
  where o.lost <= w.most and o.caught * o.n > {LOSS} * o.lost * o.n_bad),
failed as (
  select e.doc_id, string_agg([{", ".join(repr(r) for r in RULES)}][rule], ',' order by rule) as rules
  from extents e join chosen c on c.lang is not distinct from e.lang and e.extent[rule] >= c group by e.doc_id)
select m.doc_id, n::bigint as n_words, chars as word_chars, symbols::bigint as n_symbols, dups::bigint as n_dup_lines,
  repeats::bigint as n_repeat_words, base_failed, not base_failed and f.rules is null as kept, coalesce(f.rules, '') as failed_rules
from measured m left join failed f on f.doc_id = m.doc_id"""

_AUDIT = rf"""
with labelled as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
firsts as (select coalesce(text, '') as text, min(doc_id) as first from documents group by all),
texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_SPLIT} as words from documents),
flags as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [
    len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text),
    regexp_matches(t.text, '[#$%&*|]'), doc_id > first] as fails
  from texts t join firsts f on f.text = t.text left join labelled using (doc_id)),
masks as (select part, good, toxic, fails, count(*) as n from flags group by all),
letters as (select unnest(range(1, 6)) as x),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, x as step, array_to_string(list_transform(o, lambda i: chr((64 + i)::int)), '') as filter_order from orders, letters),
seen as (
  select part, filter_order, step, o[step] as letter, n, good, toxic, fails[o[step]] as failing,
    list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) is true as earlier,
    len(list_filter(fails, lambda f: f)) = 1 and fails[o[step]] as alone
  from masks, steps),
counted as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (where not failing and not earlier), 0)::bigint as kept,
    coalesce(sum(n) filter (where failing and not earlier), 0)::bigint as removed,
    coalesce(sum(n) filter (where failing and earlier), 0)::bigint as redundant,
    coalesce(sum(n) filter (where alone), 0)::bigint as unique_fails,
    coalesce(sum(n * good) filter (where failing and not earlier), 0)::bigint as good_lost,
    coalesce(sum(n * toxic) filter (where failing and not earlier), 0)::bigint as toxic_lost
  from seen group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from counted"""

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

_RANKED = f"""
with terms as (
  select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by all),
lengths as (select doc_id, sum(tf)::bigint as n from terms group by all),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from lengths),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from terms, corpus group by term),
asked as (
  select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
scored as (
  select item_id, t.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::bigint as score
  from asked a join terms t using (term) join weights using (term) join lengths l on l.doc_id = t.doc_id, corpus
  group by item_id, t.doc_id),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""

ORACLES: dict[str, str] = {
    "op11_certified_rules": _QUALITY,
    "op12_packed_filter_audit": _AUDIT,
    "op13_dual_tree_search": _RANKED,
}
