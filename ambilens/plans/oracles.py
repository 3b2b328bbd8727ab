"""The registered queries as SQL, for checking results."""

from __future__ import annotations

from ambilens.functions import prompts
from ambilens.functions.text import NOTE_MARKER, WHITESPACE_CODE_POINTS
from ambilens.plans import inputs

WS = " || ".join(f"chr({point})" for point in WHITESPACE_CODE_POINTS)
WORD_GAP = r"[^\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    """A string literal; line breaks by chr()."""
    body = text.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"('{body}')"


def listed(texts) -> str:
    return "[" + ", ".join(quoted(text) for text in texts) + "]"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def micro(expr: str) -> str:
    return f"cast(floor(({expr}) * 1e6 + 0.5) as bigint)"


# Each cleanup step is a layer of its own.
def cleaned(source: str, column: str = "raw_text", name: str = "processed_text") -> str:
    def drop_quote(layer: str) -> str:
        return (
            f"select * exclude (t), case when t like '%\"' then {strip('left(t, length(t) - 1)')} "
            f"else t end as t from ({layer})"
        )

    text = strip(f"coalesce({column}, '')")
    first = drop_quote(f"select *, {text} as t from {source}")
    cut = (
        f"select * exclude (t), contains(t, chr(10)) as cut, "
        f"{strip('split_part(t, chr(10), 1)')} as t from ({first})"
    )
    second = (
        f"select * exclude (t, cut), case when cut and t like '%\"' then "
        f"{strip('left(t, length(t) - 1)')} else t end as t from ({cut})"
    )
    note_cut = strip(f"split_part(t, '{NOTE_MARKER}', 1)")
    return f"select * exclude (t), {note_cut} as {name} from ({second})"


CANDIDATES = f"""
candidates as (
  select cast(substr(source, 4) as bigint) as source_index,
         cast(substr(source, 4) as bigint) + 2 as row_number,
         source as source_text,
         cast(cast(substr(source, 4) as bigint) >= 10 as tinyint) as ambiguity,
         cast(doc_id as int) as candidate_index,
         case when lang = 'es' then null when n_chars > 2000 then 'length' else 'stop' end
           as finish_reason,
         m.model, m.model_type,
         case when m.model_type = 'base' then text
              when n_chars < 300 then '   '
              when lang = 'en' then text || '"'
              when lang = 'fr' then text || chr(10) || 'tail "x"'
              when lang = 'de' then text || ' Note: literal'
              else chr(12288) || ' ' || text || '""' end as raw_text
  from documents
  cross join (values {", ".join(f"('{a}', '{b}')" for a, b in inputs.MODELS)}) m(model, model_type)
)"""

PROCESSED = f"{CANDIDATES}, processed as ({cleaned('candidates')})"

BLANK = f"coalesce({strip('processed_text')} = '', true)"

UNIQUE = f"""{PROCESSED}, u as (
  select distinct source_index, source_text, ambiguity, processed_text
  from processed where not {BLANK})"""

PAIRS = f"""{UNIQUE}, pairs as (
  select a.source_index, a.source_text, a.ambiguity,
         a.processed_text as sentence1, b.processed_text as sentence2
  from u a join u b on a.source_index = b.source_index and a.processed_text < b.processed_text)"""

KEY = (
    f"sha256(cast(to_json([{quoted(inputs.MODEL)}, {quoted(inputs.REVISION)}, "
    "sentence1, sentence2]) as varchar))"
)

KEYED = f"{PAIRS}, keyed as (select *, {KEY} as cache_key from pairs)"

LOGITS = (
    "[(length(sentence1) % 7) * 0.5::double, (length(sentence2) % 5) * 0.5::double, "
    "((length(sentence1) + length(sentence2)) % 3) * 0.5::double]"
)


def scored(source: str, extra: str = "") -> str:
    return f"""
  select {extra} cache_key, sentence1, sentence2, e[1] / (e[1] + e[2] + e[3]) as p0,
         e[2] / (e[1] + e[2] + e[3]) as p1, e[3] / (e[1] + e[2] + e[3]) as p2,
         case when e[1] >= e[2] and e[1] >= e[3] then 'Equivalent'
              when e[2] >= e[3] then 'Neutral' else 'Contradiction' end as prediction,
         cast(e[1] >= e[2] and e[1] >= e[3] as int) as is_equivalent
  from (select *, list_transform(logits, lambda x: exp(x - list_max(logits))) as e
        from (select *, {LOGITS} as logits from ({source})))"""


EARLIER = f"""{KEYED}, v as (
  select distinct source_index, source_text, ambiguity, processed_text from processed
  where not {BLANK} and finish_reason = 'stop'),
old_pairs as (
  select distinct a.processed_text as sentence1, b.processed_text as sentence2
  from v a join v b on a.source_index = b.source_index and a.processed_text < b.processed_text),
earlier as ({scored(f"select *, {KEY} as cache_key from old_pairs")})"""

PROBABILITIES = (
    f"{micro('p0')} as equivalent_prob, {micro('p1')} as neutral_prob, "
    f"{micro('p2')} as contradiction_prob"
)

CONVERSATIONS = """
records as (
  select cast(conv_id as varchar) as path, turn as seq, role = 'system' as is_meta, text
  from conversations),
carried as (
  select *, last_value(case when is_meta then text end ignore nulls) over (
    partition by path order by seq rows between unbounded preceding and current row) as model
  from records)"""

STATUS = """
records as (
  select conv_id as folder_id, '/raw/p/d/' || conv_id || '.pkl.gz' as path,
         turn as seq, role = 'system' as is_meta
  from conversations),
files as (
  select path, any_value(cast(folder_id as varchar)) as model_tag,
         min(seq) filter (where is_meta) as meta, min(seq) filter (where not is_meta) as batch,
         count(*) filter (where not is_meta) as n
  from records group by path),
status as (
  select path, 'p/d' as folder, model_tag,
         case when meta is null or batch < meta then 'failed' else 'written' end as status,
         case when meta is null or batch < meta then 0 else n end as n_rows,
         case when meta is null or batch < meta then 0 else n end as n_samples,
         case when batch < meta or (meta is null and batch is not null) then 'batch before metadata'
              when meta is null then 'no metadata record' end as error
  from files)"""


def generated(source: str, key: str, shift: str, vocabulary=inputs.VOCABULARY) -> str:
    v = listed(vocabulary)
    return f"""
gen as (
  select {key}, token_ids, array_to_string(list_transform(token_ids, lambda t: ({v})[t + 1]), '') as response,
         list_transform(token_ids, lambda t: list_transform(range(1, 2 + t % 3), lambda k: {{
           'token_id': (t + (k - 1) * 3) % 10, 'rank': k,
           'logprob': k * -0.25::double - {shift} * 0.125::double}})) as logprobs
  from (select *, list_transform(string_split(text, ' '), lambda w: length(w) % 10) as token_ids
        from ({source})))"""


GENERATIONS = generated(
    "select *, conv_id * 100 + turn as request_id from conversations", "request_id", "turn"
)

def cot_position(vocabulary, choices) -> str:
    ids = [i for i, token in enumerate(vocabulary) if token.strip() in choices]
    return (
        "(list_filter(range(len(token_ids)), lambda i: token_ids[i + 1] in "
        f"({', '.join(map(str, ids))})))[-1]"
    )


LAST_END = (
    f"(list_filter(range(len(token_ids) - 1), lambda i: token_ids[i + 1] = {inputs.THINK_END[0]} "
    f"and token_ids[i + 2] = {inputs.THINK_END[1]}))[-1]"
)
BLANK_IDS = ", ".join(str(i) for i, token in enumerate(inputs.VOCABULARY) if not token.strip())
POSITIONS = {
    "default": "case when len(token_ids) > 0 then 0 end",
    "cot": cot_position(inputs.VOCABULARY, prompts.IDENTIFICATION_CHOICES),
    "thinking": (
        f"(list_filter(range(len(token_ids)), lambda i: i >= {LAST_END} + 2 "
        f"and token_ids[i + 1] not in ({BLANK_IDS})))[1]"
    ),
}


def mass(choice: str, vocabulary, position: str = "position") -> str:
    ids = ", ".join(str(i) for i, token in enumerate(vocabulary) if token.strip() == choice)
    return (
        f"case when {position} is not null then coalesce(list_sum(list_transform(list_filter("
        f"logprobs[{position} + 1], lambda a: a.token_id in ({ids})), lambda a: exp(a.logprob))), 0) end"
    )


def shares(choices, vocabulary) -> str:
    first, second = (mass(choice, vocabulary) for choice in choices)
    return f"{first} as m1, {second} as m2"


SHARE = "case when m1 + m2 > 0 then {} / (m1 + m2) when m1 is not null then 0 end"


def last_choice(expr: str, choices) -> str:
    members = ", ".join(quoted(choice) for choice in choices)
    return (
        f"(list_filter(string_split_regex({expr}, '{WORD_GAP}'), lambda w: w in ({members})))[-1]"
    )


def prompt(template: str, **slots: str) -> str:
    text = quoted(template)
    for name, column in slots.items():
        text = text.replace("{%s}" % name, f"' || {column} || '")
    return text


def quoted(text: str) -> str:
    """A text as an SQL literal; line breaks are spelled out."""
    parts = (f"'{part}'" for part in text.replace("'", "''").split("\n"))
    return "(" + " || chr(10) || ".join(parts) + ")"


CORPUS = """
corpus as (
  select l.doc_id as index, d.text as src, l.toxic as ambiguity
  from labels l join documents d on l.doc_id = d.doc_id)"""

SENTENCES = """
sentences as (
  select a.item_id as pair_index, a.text as ambiguous, c.text as unambiguous
  from benchmark a join benchmark c on c.item_id = a.item_id + 1),
arranged as (
  select pair_index, ambiguous, unambiguous, ambiguous as sentence_1, unambiguous as sentence_2,
         '1' as expected_answer, 'original' as "order" from sentences
  union all
  select pair_index, ambiguous, unambiguous, unambiguous, ambiguous, '2', 'reversed'
  from sentences)"""

COT_IDENTIFICATION = prompt(prompts.IDENTIFICATION_TEMPLATES["cot"], sentence="src")
COT_COMPARISON = prompt(
    prompts.COMPARISON_TEMPLATES["cot"], sent_1="sentence_1", sent_2="sentence_2"
)
DIRECT_COMPARISON = prompt(
    prompts.COMPARISON_TEMPLATES["default"], sent_1="sentence_1", sent_2="sentence_2"
)

ANSWER = "case ambiguity when 1 then '是' when 0 then '否' end"

ORACLES: dict[str, str] = {
    "clean_translation": f"""
with {PROCESSED}
select source_index, model, candidate_index, processed_text, finish_reason from processed""",
    "flatten_candidates": f"""
with lines as (
  select doc_id as source_index, doc_id + 2 as row_number, source as source_text,
         cast(lang = 'en' as tinyint) as ambiguity, 'org/' || lang as model, '' as model_type,
         unnest(range(len(string_split(text, chr(10))))) as candidate_index,
         unnest(string_split(text, chr(10))) as raw_text,
         case when n_chars > 2000 then 'length' end as finish_reason
  from documents)
select source_index, row_number, source_text, ambiguity, model, model_type,
       cast(candidate_index as int) as candidate_index, raw_text, processed_text, finish_reason
from ({cleaned("lines")})""",
    "carry_metadata": f"""
with {CONVERSATIONS} select path, seq, model from carried where not is_meta""",
    "carried_candidates": f"""
with {CONVERSATIONS}, sound as (
  select path from records group by path
  having min(seq) filter (where is_meta) < coalesce(min(seq) filter (where not is_meta), 1e9)),
rows as (
  select path, seq, seq as source_index, cast(null as bigint) as row_number, '' as source_text,
         cast(null as tinyint) as ambiguity, coalesce(model, '') as model, 'instruct' as model_type,
         cast(0 as int) as candidate_index, text as raw_text, cast(null as varchar) as finish_reason
  from carried where not is_meta and path in (select path from sound))
select * from ({cleaned("rows")})""",
    "record_checks": """
with files as (
  select cast(conv_id as varchar) as path,
         min(turn) filter (where role = 'system') as meta,
         min(turn) filter (where role <> 'system') as batch,
         count(*) filter (where role <> 'system') as n_batches
  from conversations group by conv_id)
select path,
       case when batch < meta or (meta is null and batch is not null) then 'batch before metadata'
            when meta is null then 'no metadata record' end as reason,
       case when batch < meta or meta is null then batch end as at_seq, n_batches
from files""",
    "extract_status": f"with {STATUS} select * from status",
    "extract_summary": f"""
with {STATUS}
select status, count(*) as n_files, cast(sum(n_rows) as bigint) as n_rows
from status group by status""",
    "sampled_candidates": f"""
with lines as (
  select doc_id as source_index, doc_id + 2 as row_number, source as source_text,
         cast(lang = 'en' as tinyint) as ambiguity, 'org/Qwen3-8B-Base' as model,
         'base' as model_type,
         unnest(range(len(string_split(text, chr(10))))) as candidate_index,
         unnest(string_split(text, chr(10))) as raw_text, 'stop' as finish_reason
  from documents)
select * exclude (candidate_index), cast(candidate_index as int) as candidate_index
from ({cleaned("lines")})""",
    "batch_records": """
select lang, min(doc_id) as start_index, max(doc_id) + 1 as end_index, 'batch' as type,
       count(*) as n_samples, arg_min(text, doc_id) as first_src,
       sha256(string_agg(text, '|' order by doc_id)) as all_src
from documents group by lang, doc_id // 128""",
    "corpus_records": """
select row_number() over (order by l.doc_id) - 1 as index,
       row_number() over (order by l.doc_id) + 1 as row_number,
       d.text as src, cast(l.toxic as tinyint) as ambiguity
from labels l join documents d on l.doc_id = d.doc_id""",
    "label_checks": """
select case lang when 'fr' then 'x' else '2' end as label, count(*) as n_rows
from documents where lang in ('fr', 'de') group by 1""",
    "blank_preview": f"""
with {PROCESSED}
select candidate_index, model, source_index from processed
where {BLANK} order by candidate_index, model limit 20""",
    "source_consistency": """
with rows as (
  select cast(substr(source, 4) as bigint) as source_index,
         case when lang <> 'es' then lang end as source_text,
         cast(source = 'src1' as tinyint) as ambiguity
  from documents)
select source_index,
       count(distinct source_text) + max(cast(source_text is null as int)) as n_source_text,
       count(distinct ambiguity) + max(cast(ambiguity is null as int)) as n_ambiguity
from rows group by source_index""",
    "inconsistent_sources": """
select conv_id as source_index, n as n_variants from (
  select conv_id, count(distinct case role when 'system' then '' else role end) as n
  from conversations group by conv_id) where n > 1""",
    "duplicate_keys": f"""
with {PROCESSED}
select source_index, processed_text, count(*) as n_rows
from processed group by all having count(*) > 1""",
    "excluded_empties": f"""
with {PROCESSED}
select count(*) as n_rows, count(*) filter (where {BLANK}) as n_empty from processed""",
    "unique_translations": f"""
with {UNIQUE}
select source_index, source_text, ambiguity, processed_text from u
order by source_index, processed_text""",
    "pair_count_estimate": f"""
with {UNIQUE}, sizes as (select source_index, count(*) as n from u group by 1)
select count(*) as n_sources, cast(sum(n) as bigint) as n_texts,
       cast(sum(n * (n - 1) // 2) as bigint) as n_pairs from sizes""",
    "source_groups": f"""
with {UNIQUE}, ranked as (
  select *, row_number() over (partition by source_index order by processed_text) - 1 as rank
  from u)
select source_index, rank // 32 as block_index, source_text, ambiguity,
       count(*) as n_texts, string_agg(processed_text, '|' order by processed_text) as texts
from ranked group by source_index, rank // 32, source_text, ambiguity""",
    "translation_pairs": f"""
with {PAIRS} select * from pairs order by source_index, sentence1, sentence2""",
    "pairs_per_source": f"""
with {PAIRS} select source_index, count(*) as n_pairs from pairs group by source_index""",
    "cache_keys": f"""
with {KEYED} select source_index, sentence1, sentence2, cache_key from keyed""",
    "cache_misses": f"""
with {EARLIER}
select distinct cache_key, sentence1, sentence2 from keyed
where cache_key not in (select cache_key from earlier)""",
    "cache_hits": f"""
with {EARLIER}
select cache_key, sentence1, sentence2, {PROBABILITIES}, prediction, is_equivalent
from earlier where cache_key in (select cache_key from keyed)""",
    "cache_upsert": f"""
with {EARLIER}, entries as (
  select cache_key, sentence1, sentence2, prediction, 0 as run_seq from earlier
  union all
  select cache_key, sentence1, sentence2, prediction, 1 from ({scored("select * from keyed")}))
select cache_key, sentence1, sentence2, prediction, run_seq from (
  select *, row_number() over (partition by cache_key order by run_seq) as rank from entries)
where rank = 1""",
    "softmax_scores": f"""
with {PAIRS}
select source_index, sentence1, sentence2, {micro("p0")} as p0, {micro("p1")} as p1,
       {micro("p2")} as p2
from ({scored("select *, '' as cache_key from pairs", "source_index,")})""",
    "label_scores": f"""
with {KEYED}
select cache_key, prediction, is_equivalent from ({scored("select * from keyed")})""",
    "attached_predictions": f"""
with {EARLIER}
select v.source_index, v.source_text, v.ambiguity, e.sentence1, e.sentence2, e.prediction,
       {PROBABILITIES}, e.is_equivalent = 1 as is_equivalent, '{inputs.MODEL}' as nli_model,
       '{inputs.REVISION}' as nli_revision
from v join v w on v.source_index = w.source_index and v.processed_text < w.processed_text
join earlier e on e.sentence1 = v.processed_text and e.sentence2 = w.processed_text""",
    "normalized_labels": """
select conv_id, turn,
       case length(text) % 4 when 0 then 'equivalent' when 1 then 'neutral'
            when 2 then 'contradiction' else 'equivalent' end as label
from conversations""",
    "probability_checks": """
with v as (
  select event_id, event_type, value / 1000 as x,
         1.0 - value / 1000 as y
  from events),
p as (
  select event_id, case when event_type = 'click' then [x, y]
                        when event_type = 'purchase' then [x, x, y]
                        else [x, 0.0, y] end as p from v)
select event_id,
       case when len(p) <> 3 then 'not three values'
            when list_bool_and(list_transform(p, lambda x: isfinite(x))) = false
              then 'value is not finite'
            when list_bool_and(list_transform(p, lambda x: x >= 0 and x <= 1)) = false
              then 'value outside [0, 1]'
            when abs(list_sum(p) - 1) > 1e-4 then 'values do not sum to one' end as problem
from p""",
    "scored_pairs": f"""
with {KEYED}
select source_index, source_text, ambiguity, sentence1, sentence2, prediction, {PROBABILITIES},
       is_equivalent = 1 as is_equivalent, '{inputs.MODEL}' as nli_model,
       '{inputs.REVISION}' as nli_revision
from ({scored("select * from keyed", "source_index, source_text, ambiguity,")})""",
    "scoring_totals": f"""
with {EARLIER}
select count(*) as total_pairs,
       count(distinct cache_key) filter (where cache_key not in (select cache_key from earlier))
         as scored_pairs
from keyed""",
    "identification_prompts": f"""
with {CORPUS}
select index, {prompt(prompts.IDENTIFICATION_TEMPLATES["default"], sentence="src")} as "default",
       {COT_IDENTIFICATION} as cot, {ANSWER} as expected_answer
from corpus""",
    "comparison_prompts": f"""
with {SENTENCES}
select pair_index, ambiguous, unambiguous, sentence_1, sentence_2, expected_answer, "order",
       {COT_COMPARISON} as prompt, {DIRECT_COMPARISON} as direct
from arranged""",
    "translation_prompts": f"""
with {CANDIDATES}, contents as (
  select candidate_index, model, model_type,
         'Translate this from Chinese into English:' || chr(10) || 'Chinese: "' || raw_text || '"' as c
  from candidates)
select candidate_index, model,
       case when model_type = 'base' then c || chr(10)
            else '<user>' || chr(10) || c || chr(10) || '<assistant>' || chr(10) end
       || 'English: "' as prompt
from contents""",
    "model_names": f"""
with named as (
  select page_id, v.variant, url || v.suffix as model
  from pages cross join (
    select unnest(range(len({listed(inputs.MODEL_NAMES)}))) as variant,
           unnest({listed(inputs.MODEL_NAMES)}) as suffix) v),
based as (select *, string_split(rtrim(model, '/'), '/')[-1] as base from named),
typed as (
  select *, lower(base) as name,
         case when contains(lower(base), 'qwen3')
                then case when contains(lower(base), 'base') then 'base' else 'instruct' end
              when contains(lower(base), 'qwen2.5')
                then case when contains(lower(base), 'instruct') then 'instruct' else 'base' end
         end as inferred
  from based)
select page_id, cast(variant as int) as variant, inferred,
       coalesce(inferred, 'instruct') as model_type,
       replace(name, '-', '_') as tag, base || '_thinking' as report,
       trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') as slug
from typed""",
    "parse_answer": f"""
with {GENERATIONS}
select 'documents' as origin, doc_id as id,
       {last_choice("text", prompts.COMPARISON_CHOICES)} as answer from documents
union all
select 'generations', request_id,
       {last_choice("response", prompts.IDENTIFICATION_CHOICES)} from gen""",
    "last_subsequence": f"""
with {GENERATIONS} select request_id, cast({LAST_END} as int) as start from gen""",
    "token_logprobs": f"""
with {GENERATIONS}, flat as (
  select request_id, unnest(range(len(token_ids))) as position, unnest(token_ids) as token_id,
         unnest(logprobs) as top
  from gen)
select request_id, cast(position as int) as position, cast(token_id as int) as token_id,
       ({listed(inputs.VOCABULARY)})[token_id + 1] as token,
       cast(floor(list_filter(top, lambda a: a.token_id = flat.token_id)[1].logprob * 1000 + 0.5)
            as bigint) as sampled_logprob,
       array_to_string(list_transform(top,
         lambda a: ({listed(inputs.VOCABULARY)})[a.token_id + 1]), '|') as top_tokens,
       len(top) as n_top
from flat""",
    "decoded_tokens": f"""
with {GENERATIONS}, flat as (
  select request_id, unnest(range(len(token_ids))) as position, unnest(logprobs) as top from gen),
alternatives as (select request_id, position, unnest(top) as a from flat)
select request_id, cast(position as int) as position, cast(a.rank as int) as rank,
       case when a.rank = 2 and a.token_id = 6 then '6'
            else ({listed(inputs.VOCABULARY)})[a.token_id + 1] end as token
from alternatives""",
    "identification_results": f"""
with {CORPUS}, {generated("select *, doc_id as index from documents", "index", "0")},
placed as (select *, {POSITIONS["cot"]} as position from gen),
massed as (select *, {shares(prompts.IDENTIFICATION_CHOICES, inputs.VOCABULARY)} from placed)
select c.index, src as sentence, ambiguity as label, {ANSWER} as expected_answer,
       {COT_IDENTIFICATION} as input_text, {strip("response")} as response,
       {last_choice(strip("response"), prompts.IDENTIFICATION_CHOICES)} as parsed_answer,
       cast(position as int) as decision_token_position,
       {micro(SHARE.format("m1"))} as share_first, {micro(SHARE.format("m2"))} as share_second
from corpus c join massed g on c.index = g.index""",
    "comparison_results": f"""
with {SENTENCES}, {generated(
    '''select item_id as pair_index, 'original' as "order", text from benchmark
       union all select item_id, 'reversed', 'a ' || text from benchmark''',
    'pair_index, "order"', "0", inputs.PAIR_VOCABULARY)},
placed as (
  select *, {cot_position(inputs.PAIR_VOCABULARY, prompts.COMPARISON_CHOICES)} as position from gen),
massed as (select *, {shares(prompts.COMPARISON_CHOICES, inputs.PAIR_VOCABULARY)} from placed)
select a.pair_index, a."order", ambiguous as ambiguous_sentence,
       unambiguous as unambiguous_sentence, sentence_1, sentence_2, expected_answer,
       {COT_COMPARISON} as input_text, {strip("response")} as response,
       {last_choice(strip("response"), prompts.COMPARISON_CHOICES)} as parsed_answer,
       cast(position as int) as decision_token_position,
       {micro(SHARE.format("m1"))} as share_first, {micro(SHARE.format("m2"))} as share_second
from arranged a join massed g on a.pair_index = g.pair_index and a."order" = g."order" """,
}

ARCHIVED = f"""
files as (
  select lang, source || '_' || cast(doc_id // 2000 as varchar) as name from documents group by all)"""

ORACLES |= {
    "extracted_archives": f"""
with lines as (
  select doc_id as source_index, doc_id + 2 as row_number, source as source_text,
         cast(lang = 'en' as tinyint) as ambiguity, 'org/' || lang as model, 'base' as model_type,
         unnest(range(len(string_split(text, chr(10))))) as candidate_index,
         unnest(string_split(text, chr(10))) as raw_text,
         case when n_chars > 2000 then 'length' end as finish_reason, lang as folder
  from documents)
select * exclude (candidate_index), cast(candidate_index as int) as candidate_index
from ({cleaned("lines")})""",
    "extraction_reruns": f"""
with {ARCHIVED}, n as (select count(*) as n from files),
held as (
  select sum(len(string_split(text, chr(10)))) as n_rows, count(*) as n_samples,
         coalesce(sum(len(string_split(text, chr(10)))) filter (where lang = 'en'), 0) as rows_en,
         coalesce(count(*) filter (where lang = 'en'), 0) as samples_en
  from documents)
select run, status, n_files, n_rows::bigint as n_rows, n_samples::bigint as n_samples from (
select 0 as run, 'written' as status, n as n_files, n_rows, n_samples from n, held
union all select 1, 'skipped', n, 0, 0 from n
union all select 1, 'written', 1, rows_en, samples_en from held union all select 1, 'failed', 1, 0, 0
union all select 2, 'written', n + 1, n_rows + rows_en, n_samples + samples_en from n, held
union all select 2, 'failed', 1, 0, 0)""",
    "corpus_csv_strict": f"""
with {CORPUS} select src, cast(ambiguity as tinyint) as ambiguity, 2 as first_row from corpus""",
    "corpus_csv_lenient": f"""
with {CORPUS} select src, cast(ambiguity as tinyint) as ambiguity, 2 as first_row from corpus""",
    "sentence_pair_csv": f"""
with {SENTENCES} select ambiguous, unambiguous from sentences""",
    "aggregated_models": f"""
with {UNIQUE}
select source_index, source_text, ambiguity, processed_text,
       (select count(*) from processed) as n_rows,
       (select count(*) from processed where {BLANK}) as n_empty,
       (select count(*) from u) as n_unique
from u""",
    "scoring_job": f"""
with {KEYED}, total as (select count(distinct cache_key) as cached from keyed)
select source_index, source_text, ambiguity, sentence1, sentence2, prediction, {PROBABILITIES},
       is_equivalent = 1 as is_equivalent, '{inputs.MODEL}' as nli_model,
       '{inputs.REVISION}' as nli_revision, 0 as scored_again, cached, 1 as from_cache
from ({scored("select * from keyed", "source_index, source_text, ambiguity,")}) cross join total""",
    "pair_keys": f"""
with {SENTENCES}, ordered as (
  select pair_index, least(ambiguous, unambiguous) as sentence1,
         greatest(ambiguous, unambiguous) as sentence2
  from sentences where ambiguous <> unambiguous)
select *, true as same, {KEY} as cache_key from ordered""",
    "evaluation_job": f"""
select *, 'org/m' as model_id, 'documents' as dataset, 'cot' as prompt_style, {quoted(prompts.IDENTIFICATION_TEMPLATES["cot"])} as prompt_template,
       false as thinking, '{{"n": 1}}' as sampling_config
from ({ORACLES['identification_results']})""",
    "refusals": f"""
with misses as (select count(*) as n from ({ORACLES['cache_misses']})),
odd as (select count(*) as n from labels join documents using (doc_id) where doc_id % 5 = 0)
select * from (
select 'columns' as "check", true as bad, true as refused, 1::bigint as n_bad
union all select 'output exists', true, true, count(*) from documents
union all select 'keys differ', true, true, count(*) from documents where doc_id % 7 = 0
union all select 'no prediction', true, true, n from misses
union all select 'labels, strict', true, true, n from odd
union all select 'labels, lenient', true, true, n from odd
union all select unnest(['columns', 'output exists', 'keys differ', 'no prediction', 'labels, strict', 'labels, lenient']), false, false, 0)""",
    "spelled_results": ORACLES["identification_results"],
}

for _mode, _position in POSITIONS.items():
    ORACLES[f"decision_position_{_mode}"] = (
        f"with {GENERATIONS} select request_id, cast({_position} as int) as position from gen"
    )
    ORACLES[f"choice_probabilities_{_mode}"] = f"""
with {GENERATIONS}, placed as (select *, {_position} as position from gen),
massed as (
  select *, {shares(prompts.IDENTIFICATION_CHOICES, inputs.VOCABULARY)} from placed)
select request_id, {micro("m1")} as raw_yes, {micro("m2")} as raw_no,
       {micro(SHARE.format("m1"))} as share_yes, {micro(SHARE.format("m2"))} as share_no
from massed"""
