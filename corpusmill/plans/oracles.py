"""DuckDB SQL for the library's queries. Those that need Python's JSON, or hash whole rows or files, have none."""

from __future__ import annotations

from corpusmill.functions import guardrails
from corpusmill.functions.canonical import UNITS
from corpusmill.functions.text import STOPWORDS
from corpusmill.plans import catalog
from corpusmill.plans.more import MORE_SQL


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_DOCS = "docs as (select *, cast(substr(source, 4) as int) as domain_index from documents)"
_SPLIT = f"{_DOCS}, sd as (select *, case when domain_index < 14 then 'train' when domain_index < 17 then 'validation' else 'test' end as split from docs)"
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_CONTENT = f"list_filter(list_distinct({_TOKENS}), lambda t: not list_contains({_list(STOPWORDS)}, t))"
_UPDATES = """e as (select doc_id, 'quality' as slot_id, quality::varchar as value from labels union all select doc_id, 'toxic', toxic::varchar from labels),
p as (select d.doc_id, s.slot_id, s.value from labels join documents d using (doc_id), lateral (select unnest([
  {'slot_id': 'quality', 'value': (n_chars >= 200)::int::varchar}, case when n_chars % 3 <> 0 then {'slot_id': 'toxic', 'value': '0'} end, case when n_chars % 7 = 0 then {'slot_id': 'length', 'value': 'x'} end]) as s) where s is not null)"""
_COUNTS = f"""{_UPDATES},
j as (select coalesce(e.doc_id, p.doc_id) as doc_id, e.doc_id is not null as ine, p.doc_id is not null as inp, e.value is not distinct from p.value as same from e full join p on e.doc_id = p.doc_id and e.slot_id = p.slot_id),
c as (select doc_id, count(*) filter (ine and inp and same) as tp, count(*) filter (inp and not (ine and same)) as fp, count(*) filter (ine and not (inp and same)) as fn,
  count(*) filter (ine and inp) as id_tp, count(*) filter (inp and not ine) as id_fp, count(*) filter (ine and not inp) as id_fn, count(*) filter (ine) as n_expected, count(*) filter (inp) as n_predicted from j group by doc_id)"""


def _rate(part: str, whole: str, digits: int = 4) -> str:
    return f"coalesce(round_even(({part})::double / nullif(({whole})::double, 0), {digits}), 0)"


def _f1(p: str, r: str) -> str:
    return f"coalesce(round_even(2 * {p} * {r} / nullif({p} + {r}, 0), 4), 0)"


def _prf(tp: str, fp: str, fn: str, name: str) -> str:
    p, r = _rate(tp, f"{tp} + {fp}"), _rate(tp, f"{tp} + {fn}")
    return f"{p} as {name}_precision, {r} as {name}_recall, {_f1(p, r)} as {name}_f1"


_S = {c: f"sum({c})" for c in ("tp", "fp", "fn", "id_tp", "id_fp", "id_fn")}
_COMPONENT = f"""with {_COUNTS},
r as (select lang as category, case when c.doc_id % 4 = 0 then 'ask' else 'extract' end as task, c.doc_id % 11 <> 0 as ok, c.*, n_chars::double as ms, n_chars as k, text from c join documents using (doc_id)),
a as (select *, task = 'extract' as ex, task = 'ask' as q, task = 'extract' and ok as good, regexp_matches(trim(text), '^[^?]*[?]$') as oneq from r)
select category, {_rate("count(*) filter (ok)", "count(*)")} as provider_success_rate, {_rate("count(*) filter (good and k % 2 <> 0)", "count(*) filter (ex)")} as intent_accuracy,
{_prf("sum(tp) filter (good)", "sum(fp) filter (good)", "sum(fn) filter (ex)", "slot_micro")}, {_prf("sum(id_tp) filter (good)", "sum(id_fp) filter (good)", "sum(id_fn) filter (ex)", "slot_id_micro")},
{_rate("sum(tp) filter (good)", "sum(id_tp) filter (good)")} as matched_slot_value_accuracy,
{_rate("count(*) filter (ex and n_expected > 0) - count(*) filter (ex and n_expected > 0 and (not ok or n_predicted = 0))", "count(*) filter (ex and n_expected > 0)")} as nonempty_update_accuracy,
{_rate("count(*) filter (ex and n_expected > 0 and (not ok or n_predicted = 0))", "count(*) filter (ex and n_expected > 0)")} as empty_update_collapse_rate,
{_rate("count(*) filter (good and k % 3 <> 0)", "count(*) filter (ex)")} as joint_extraction_accuracy, {_rate("count(*) filter (good and k % 5 <> 0)", "count(*) filter (ex)")} as correction_detection_accuracy,
{_rate("count(*) filter (good and k % 13 = 0)", "count(*) filter (good and k % 7 <> 0)")} as forbidden_slot_inference_rate,
{_rate("count(*) filter (q and k % 2 <> 0)", "count(*) filter (q)")} as question_contract_accuracy, {_rate("count(*) filter (q and oneq)", "count(*) filter (q)")} as one_question_compliance,
{_rate("count(*) filter (q and k % 3 <> 0)", "count(*) filter (q)")} as question_slot_relevance, {_rate("count(*) filter (q and k % 6 <> 0)", "count(*) filter (q)")} as question_exact_match_accuracy,
{_rate("count(*) filter (q and k % 5 > 1 and k % 4 <> 0)", "count(*) filter (q)")} as question_content_accuracy, coalesce(round_even(avg((k % 8) / 8.0) filter (q), 4), 0) as question_content_token_f1,
round_even(avg(ms), 1) as latency_mean, round_even(median(ms), 1) as latency_p50, round_even(quantile_disc(ms, 0.95), 1) as latency_p95, count(*) as calls, count(*) filter (ex) as extract_calls, count(*) filter (q) as ask_calls
from a group by grouping sets ((category), ())"""
_CLEAN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_PICK = "{0}[(length(text) % {1} + 1)::int]"
_TURN = "c as (select *, lag(x) over (partition by conv_id order by turn) as px, lag(m) over (partition by conv_id order by turn) as pm, lag(i) over (partition by conv_id order by turn) as pi from t)"


def _low(slot: str, value: str) -> str:
    return "case " + " ".join(f"when {slot} = '{s}' then {_CLEAN.format(value)} in ({_list(w)[1:-1]})" for s, w in guardrails.LOW_INFORMATION.items()) + " else false end"


ORACLES: dict[str, str] = {
    "split_counts": f"with {_SPLIT} select split, count(*) as n from sd group by split",
    "extended_split_counts": "with d as (select cast(doc_id % 33 as int) as domain_index from documents) select domain_index, case when domain_index < 14 then 'train' when domain_index < 17 then 'validation' when domain_index < 20 then 'test' when domain_index < 27 then 'train' when domain_index < 30 then 'validation' else 'test' end as split, count(*) as n from d group by all",
    "dedup_first_seen": "select doc_id, source from (select *, row_number() over (partition by sha256(text) order by doc_id) as r from documents) where r = 1",
    "sft_manifest": f"with {_SPLIT} select split, count(*) as n, sum(n_chars)::bigint as chars from (select *, row_number() over (partition by text order by doc_id) as r from sd) where r = 1 and split <> 'test' group by split",
    "cross_split_duplicates": f"with {_SPLIT} select sha256(text) as sha256, count(distinct split) as n_splits, count(*) as n from sd group by 1 having count(distinct split) > 1",
    "domain_disjointness": f"with {_SPLIT} select source, count(distinct split) as n_splits, count(*) as n from sd group by 1 having count(distinct split) > 1",
    "normalized_text": f"select doc_id, sha256(array_to_string({_TOKENS.format('text')}, ' ')) as normalized_sha256, sha256({_CLEAN.format('text')}) as spaced_sha256 from documents",
    "content_token_counts": f"select doc_id, len({_TOKENS.format('text')})::int as n_tokens, len({_CONTENT.format('text')})::int as n_content from documents",
    "token_f1_pairs": f"select u.conv_id, u.turn, len({_CONTENT.format('u.text')})::int as n_user, len({_CONTENT.format('a.text')})::int as n_assistant, len(list_intersect({_CONTENT.format('u.text')}, {_CONTENT.format('a.text')}))::int as shared, case when n_user = 0 and n_assistant = 0 then 1.0 when shared = 0 then 0.0 else round_even(2 * (shared / n_assistant) * (shared / n_user) / (shared / n_assistant + shared / n_user), 4) end::double as f1 from conversations u join conversations a on u.conv_id = a.conv_id and u.turn + 1 = a.turn where u.role = 'user' and a.role = 'assistant'",
    "slot_update_counts": f"with {_COUNTS} select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(id_tp)::bigint as id_tp, sum(id_fp)::bigint as id_fp, sum(id_fn)::bigint as id_fn, sum(id_tp)::bigint as matched, sum(tp)::bigint as matched_correct from c",
    "slot_micro_prf": f"with {_COUNTS} select {_prf(_S['tp'], _S['fp'], _S['fn'], 'slot_micro')}, {_prf(_S['id_tp'], _S['id_fp'], _S['id_fn'], 'slot_id_micro')}, {_rate('sum(tp)', 'sum(id_tp)')} as matched_slot_value_accuracy from c",
    "component_category_metrics": _COMPONENT,
    "latency_summary": "select event_type, count(value) as n, round_even(avg(value), 1) as mean, round_even(median(value), 1) as p50, round_even(quantile_disc(value, 0.95), 1) as p95 from events group by grouping sets ((event_type), ())",
    "prev_assistant_repeat": "with m as (select user_id, coalesce(event_type = lag(event_type) over (partition by user_id order by ts, event_id), false) as r from events), u as (select user_id, count(*) as n, count(*) filter (r) as repeats from m group by 1) select sum(repeats)::bigint as repeats, sum(greatest(0, n - 1))::bigint as chances from u",
    "turn_progress": f"with t as (select conv_id, turn, trim(case when role = 'assistant' then text end) as x, length(text) % 5 + turn as m, role as i from conversations), {_TURN} select conv_id as case_id, turn, coalesce(x = px and x <> '', false) as repeated_previous_question, m > coalesce(pm, 0) or i is distinct from pi as state_progressed from c",
    "conversation_turn_metrics": f"with t as (select conv_id, turn, 'same?' as x, length(text) % 3 as m, 'x' as i from conversations), {_TURN}, n as (select conv_id, count(*) as n, count(*) filter (m > coalesce(pm, 0) or i is distinct from pi) as moved, count(*) filter (x = px) as repeats from c group by 1) select {_rate('sum(moved)', 'sum(n)')} as state_progression_rate, {_rate('sum(n) - sum(moved)', 'sum(n)')} as stalled_turn_rate, {_rate('sum(repeats)', 'sum(greatest(0, n - 1))')} as consecutive_question_repeat_rate, {_rate('sum(n)', 'count(*)', 2)} as average_turns, count(*) as cases, sum(n)::bigint as turns from n",
    "conversation_state_metrics": f"with {_COUNTS}, s as (select sum(tp)::double as tp, sum(id_tp)::double as ids, sum(n_expected)::double as ne, sum(n_predicted)::double as np, sum(id_fp)::double as extra from c) select round_even(tp / np, 4) as slot_micro_precision, round_even(tp / ne, 4) as slot_micro_recall, round_even(2 * (tp / np) * (tp / ne) / (tp / np + tp / ne), 4) as slot_micro_f1, round_even(ids / np, 4) as slot_id_micro_precision, round_even(ids / ne, 4) as slot_id_micro_recall, round_even(2 * (ids / np) * (ids / ne) / (ids / np + ids / ne), 4) as slot_id_micro_f1, round_even(extra / np, 4) as unexpected_slot_inference_rate from s",
    "conversation_record_metrics": f"select {_rate('count(*) filter (quality = 1)', 'count(*)')} as case_success_rate, {_rate('count(*) filter (toxic = 0)', 'count(*)')} as intent_accuracy, {_rate('count(*) filter (doc_id % 2 = 0 and quality = 0)', 'count(*)')} as exact_final_state_accuracy, {_rate('count(*) filter (doc_id % 3 <> 0 or toxic = 1)', 'count(*)')} as assistant_safety_rate from labels",
    "trace_metrics": f"with t as (select length(text) as k, unnest(range(0, length(text) % 3 + 1)) as i, conv_id, turn from conversations), o as (select *, (k + i) % 5 as op, (k + i) % 4 <> 0 as parsed from t), n as (select conv_id, turn, count(*) filter (op < 2) as calls, count(*) filter (op < 2 and parsed) as parsed, bool_or(op in (2, 3)) as fixed from o group by 1, 2) select round_even(sum(parsed)::double / nullif(sum(calls), 0), 4) as structured_output_validity_rate, sum(calls)::bigint as structured_model_calls, {_rate('count(*) filter (fixed)', 'count(*)')} as deterministic_turn_rate from n",
    "last_assistant_question": "select conv_id, turn, sha256(last_value(case when role = 'assistant' and text <> '' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)) as last_question_sha256 from conversations",
    "turn_enumeration": "select conv_id, row_number() over (partition by conv_id order by turn)::int as turn_index, role from conversations",
    "conversation_lengths": "select count(*) as cases, sum(n)::bigint as turns, max(n) as longest from (select count(*) as n from conversations group by conv_id)",
    "chat_to_prompt_completion": "with c as (select conv_id, list({'role': role, 'text': text} order by turn) as m from conversations group by 1) select conv_id, (len(m) - 1)::int as n_prompt, m[-1].role as role, sha256(m[-1].text) as completion_sha256 from c",
    "benchmark_contamination": "select doc_id, item_id from documents join benchmark on contains(documents.text, benchmark.text)",
    "evidence_containment": "select a.doc_id, len(list_filter(string_split(a.text, chr(10)), lambda x: contains(b.text, x)))::int as grounded from documents a join documents b on a.doc_id = b.doc_id + 1",
    "unknown_slot_anti_join": "select doc_id from documents anti join labels using (doc_id)",
    "resume_pending": "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1 and toxic = 0)",
    "forbidden_slot_overlap": f"select doc_id from documents where list_has_any({_TOKENS.format('text')}, ['idiot', 'scum', 'pathetic', 'disgusting', 'loser'])",
    "ring_successor": "with s as (select distinct cast(substr(source, 4) as int) as domain_index, source from documents) select a.domain_index, a.source, b.source as next_source from s a left join s b on b.domain_index = (a.domain_index + 1) % 20",
    "report_winner": "with p as (select lang, count(*)::double as documents, sum(n_chars)::double as chars, min(n_chars)::double as shortest, max(n_chars)::double as longest from documents group by 1), u as (unpivot p on documents, chars, shortest, longest into name metric value value), k as (select unnest(['en', 'de']) as a, unnest(['fr', 'es']) as b), v as (select a, b, m.metric, e.value as l, f.value as r from k cross join (select distinct metric from u) m left join u e on e.metric = m.metric and e.lang = a and m.metric <> 'longest' left join u f on f.metric = m.metric and f.lang = b) select a || '-' || b as pair, metric, l as left_value, r as right_value, round_even(l - r, 4) as delta, case when l is null or r is null then 'unavailable' when l = r then 'tie' when (l > r) = (metric <> 'shortest') then a else b end as winner from v",
    "sampling_offset_limit": "select doc_id, source from documents order by doc_id limit 25 offset 50",
    "sampling_indices": "select doc_id, source from (select *, row_number() over (order by doc_id) - 1 as i from documents) where i in (0, 3, 17, 150, 9999999)",
    "preview_overlength": f"select doc_id, len({_TOKENS.format('text')})::int as n_tokens from documents where len({_TOKENS.format('text')}) > 2000 order by doc_id limit 10",
    "length_profile": f"with {_SPLIT}, w as (select split, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::int as n from sd) select split, count(*) as n, min(n) as shortest, max(n) as longest, sum(n)::bigint as total, count(*) filter (n > 1000) as over_limit from w group by split",
    "scenario_matrix_v1": "with c as (select unnest(['complete', 'missing_required', 'ambiguous', 'correction', 'conflicting', 'multi_series', 'probabilistic_covariate', 'governance_privacy', 'robustness', 'intent_boundary']) as category), d as (select i from (select distinct doc_id % 33 as i from documents) where i < 20) select category, case when i < 14 then 'train' when i < 17 then 'validation' else 'test' end as split, count(*) as n, sum(case when category = 'correction' then 2 else 1 end)::bigint as turns from c, d group by all",
    "conversational_matrix": "with d as (select i from (select distinct doc_id % 33 as i from documents) where i < 20), s as (select case when i < 14 then 'train' when i < 17 then 'validation' else 'test' end as split, unnest(range(16)) as k from d) select split, count(*) as n, count(*) filter (k >= 10) as conversational, count(*) filter (k not in (0, 9, 15)) as asking from s group by split",
    "sft_variants": "with d as (select i from (select distinct doc_id % 33 as i from documents) where i < 17), s as (select case when i < 14 then 'train' else 'validation' end as split, i from d), v as (select unnest(['selected_short', 'selected_sentence', 'selected_non_answer']) as variant), b as (select split, i, unnest(range(17)) as k from s), f as (select split, case when k < 3 then k when k = 3 and i % 2 = 0 then 3 else 100 + i * 100 + k end as message, i from b), u as (select arg_min(split, i) as split from f group by message) select split, 'reviewed_base' as variant, count(*) as n from u group by split union all select split, variant, count(*) * 16 from s, v group by all",
    "corpus_expectations": "select name, case name when 'size' then abs((select count(distinct doc_id % 33) * 10 from documents where doc_id % 33 < 20) - 200) else 0 end::bigint as violations from (select unnest(['known gold slots', 'known forbidden slots', 'known question slot', 'one question mark', 'grounded evidence', 'size', 'unique ids', 'disjoint domains']) as name)",
    "table_expectations": "select 'has text' as name, count(*) filter (text = '') as violations from documents union all select 'counts characters', count(*) filter (n_chars <> length(text)) from documents union all select 'short', count(*) filter (n_chars > 2000) from documents union all select 'english', count(*) filter (lang <> 'en') from documents",
    "slot_coverage": "select d.source, count(l.doc_id) as n from documents d left join labels l on l.doc_id = d.doc_id and l.toxic = 1 group by 1",
    "multiset_equality": "select lang, source, count(*)::bigint as surplus from documents where lang = 'es' group by all",
    "set_operations": "select 'intersect' as operation, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all select 'except', count(*) from (select doc_id from documents except all select doc_id from labels) union all select 'union', count(*) from (select doc_id from documents union all select doc_id from labels)",
    "render_values": "with v as (select *, o_orderkey % 5 + 1 as n, ['day', 'week', 'month'][(o_orderkey % 3 + 1)::int] as unit from orders) select o_orderkey, case o_orderkey % 4 when 0 then case when o_custkey % 2 = 0 then 'yes' else 'no' end when 1 then n || ' ' || unit || case when n <> 1 then 's' else '' end when 2 then o_orderstatus || ', ' || o_orderpriority else o_orderpriority end as rendered from v",
    "filled_templates": f"select n_nationkey, replace(case when n_nationkey % 2 = 0 then '{catalog.SENTENCES['business_goal']}' else '{catalog.ROMAN_URDU['business_goal']}' end, '{{value}}', n_name || ' data') as message, case when n_nationkey = 0 then 'yes' when n_nationkey < 5 then 'uploaded' else n_name end as short from nation",
    "pad_to_n": "with n as (select n_regionkey, list(n_name order by n_name) as names from nation group by 1) select n_regionkey, array_to_string(list_concat(names, ['none', 'none', 'none', 'none', 'none', 'none', 'none'])[1:7], '|') as padded from n",
    "rotating_pick": f"select n_nationkey, {_list(catalog.NON_ANSWERS)}[((n_nationkey + n_regionkey) % 3 + 1)::int] as non_answer from nation",
    "last_write_wins": "select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2",
    "evidence_carry_forward": "with c as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as f from events window w as (partition by user_id order by event_id)), r as (select *, sum(f) over (partition by user_id order by event_id) as run from c) select event_id, first_value(props) over (partition by user_id, run order by event_id) as original_evidence from r",
    "checksum_manifest": "select doc_id, sha256(text) as sha256, strlen(text)::int as bytes from documents",
    "low_information_values": f"with v as (select *, case when conv_id % 2 = 0 then 'target_description' else 'business_goal' end as slot, {_PICK.format(_list((' Forecast!', 'planning', 'sales', 'Time-series', 'unknown')), 5)} as value from conversations) select conv_id, turn, {_low('slot', 'value')} as drops from v",
    "recovered_intents": f"with v as (select *, {_PICK.format(_list(('Yes!', 'no', 'I do not want a forecast', 'please predict sales', 'hello', 'Haan')), 6)} as value from conversations) select conv_id, turn, case when value in ('no', 'I do not want a forecast') then 'not_forecasting' when value <> 'hello' then 'create_forecast' end as intent from v",
    "short_slot_answers": f"with v as (select *, unnest(regexp_split_to_array(text, '[.,\\n]')) as m, generate_subscripts(regexp_split_to_array(text, '[.,\\n]'), 1) - 1 as part from conversations), w as (select *, trim(m) as own, {_CLEAN.format('trim(m)')} as plain from v) select conv_id, turn, part::int as part, case when own <> '' and length(own) <= 120 and len(regexp_split_to_array(own, '\\s+')) <= 4 and not contains(own, '?') and plain not in ({_list(guardrails.NON_ANSWERS)[1:-1]}) and not regexp_matches(plain, '{guardrails.INSTRUCTION}') and not (len(string_split(plain, ' ')) > 1 and regexp_matches(plain, '{guardrails.SENTENCE}')) then own end as answer from w",
    "repeat_guard": "with q as (select conv_id, turn, 'What next ' || length(text) % 2 || '?' as question from conversations) select conv_id, turn, case when question = lag(question) over (partition by conv_id order by turn) then 'Please answer the question above.' else question end as question from q",
    "safe_labels": "select p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '-', 'g') as label, p_brand || ' status=' || p_size || ' code=' || p_type as error from part",
    "latest_checkpoint": "select 'out/checkpoint-' || max(n_chars) as path, max(n_chars) as step from documents where doc_id % 2 = 0",
    "duration_parse": f"select event_id, (event_id % 9 + 1)::double as periods, {_list([UNITS[u] for u in sorted(UNITS)])}[(event_id % {len(UNITS)} + 1)::int] as unit from events",
    "excluded_cases": "select doc_id, source from documents where source not in ('src0', 'src5', 'src11')",
    "guided_cases": "select 'guided-series_0' || i as case_id, 18 as turns, 'value_0' || i || '_' || count(*) as second from (select doc_id % 33 as i from documents) where i < 4 group by i",
    "event_windows": "select date_trunc('day', ts) as start, event_type, count(*) as n, round_even(avg(value), 9) as mean from events group by all",
}
_CHECKS = """with k as (select doc_id, contains(lower(text), 'the') as contains_required_text, contains(lower(text), 'license') or contains(lower(text), 'token') as contains_any_text,
not contains(lower(text), '@') and not contains(lower(text), 'all rights') as avoids_forbidden_text, len(regexp_extract_all(text, '\\?'))::int as question_marks, len(regexp_extract_all(text, '(?m)^\\s*\\d+[.)]'))::int as numbered_items from documents),
a as (select *, question_marks <= 0 as question_limit, numbered_items <= 0 as numbered_item_limit from k)"""
ORACLES["answer_checks"] = f"{_CHECKS} select * from a"
ORACLES["automated_pass"] = f"{_CHECKS} select count(*) as n, count(*) filter (contains_required_text and contains_any_text and avoids_forbidden_text and question_limit and numbered_item_limit) as passes from a"
_LOOSE, _COMPACT = ("""'{"k":%s' || json_extract_string(props, '$.k') || '}'""" % gap for gap in (" ", ""))
ORACLES["canonical_json"] = f"select event_id, {_LOOSE} as loose, {_COMPACT} as compact from events"
ORACLES["json_salvage"] = f"select event_id, {_LOOSE} as object from events"
ORACLES["corpus_manifest"] = f"""with {_SPLIT}, c as (select 'split_counts' as what, split as k, count(*) as n from sd group by 2 union all select 'lang_counts', lang, count(*) from sd group by 2)
select what, '{{' || string_agg('"' || k || '":' || n, ',' order by k) || '}}' as json from c group by 1 union all select 'count', count(*)::varchar from documents union all select 'version', '"tables"'"""
ORACLES["content_digest"] = "select count(*) as rows, sum(('0x' || substr(sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})::varchar), 1, 15))::bigint)::varchar as digest from documents"
_SAYS = "trim(substr(text, 1, 10))"
ORACLES["grounded_evidence"] = f"""with v as (select *, trim(text) as m, trim(lower(text)) as t, {_SAYS} as e from conversations),
b as (select *, list_bool_or(list_transform({_list(guardrails.LEAKS)}, lambda x: contains(lower(e), x))) or (length(e) > 2 and not contains(t, lower(e))) as bad from v),
k as (select *, list_filter([case when not (bad and length(t) <= 3 and not contains('1', t)) then case when bad then m else e end when not (length(t) <= 3 and not contains('1', t)) then m end, case when not (length(t) <= 3 and not contains('2', t)) then m end], lambda x: x is not null) as own from b)
select conv_id, turn, len(own)::int as n, sha256(array_to_string(own, '|')) as evidence_sha256 from k"""
ORACLES |= MORE_SQL
