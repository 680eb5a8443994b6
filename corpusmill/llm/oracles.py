"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from corpusmill.llm import urls

#: A union of repeated spans of 20 words or more is the union of 20-word windows seen twice in the text;
#: a repeat over 50 words is a 51-word window seen twice. Two equal stretches that no word before or after extends are a maximal repeat.
OP9 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
t as (select r, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
win as (
  select r, n, i, case when i + 4 <= n then list(word) over (partition by r order by i rows between current row and 4 following) end as w5,
    case when i + 19 <= n then list(word) over (partition by r order by i rows between current row and 19 following) end as w20,
    case when i + 50 <= n then md5(string_agg(word, ' ') over (partition by r order by i rows between current row and 50 following)) end as w51
  from t),
rep as (
  select r, i, w5 is not null and count(*) over (partition by r, w5) > 1 as r5, w20 is not null and count(*) over (partition by r, w20) > 1 as r20,
    w51 is not null and count(*) over (partition by r, w51) > 1 as r51
  from win),
cov as (
  select r, bool_or(r5) over (partition by r order by i rows between 4 preceding and current row) as c5,
    bool_or(r20) over (partition by r order by i rows between 19 preceding and current row) as c20, r51
  from rep),
s as (select r, count(*) filter (c5) as n_repeat_words, count(*) filter (c20) as n_covered, bool_or(r51) as too_long from cov group by r),
e as (select x.r, x.i, y.i - x.i as q from t x join t y on x.r = y.r and x.word = y.word and y.i > x.i),
z as (select r, q, min(i) as i, count(*) as size from (select *, i - row_number() over (partition by r, q order by i) as island from e) group by r, q, island having count(*) >= 5),
m as (select r, max(size) as longest_repeat, count(distinct case when size >= 20 then array_to_string(ws[i:i + size - 1], ' ') end) as n_maximal from z join w using (r) group by r),
l as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r)
select doc_id, len(ws)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  coalesce(n_covered, 0)::bigint as n_covered, coalesce(longest_repeat, 0)::bigint as longest_repeat, coalesce(n_maximal, 0)::bigint as n_maximal,
  len(ws) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) as base_failed,
  not (len(ws) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(ws)) and not coalesce(100 * n_covered > 10 * len(ws) or too_long, false) as kept
from w left join s using (r) left join l using (r) left join m using (r)
"""

OP5 = r"""
with fold as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents, fold),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark, fold),
bw as (select item_id, ws, least(len(ws), 10) as size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0),
win as (select distinct item_id, size, array_to_string(ws[i:i + size - 1], ' ') as w from bw),
sizes as (select distinct size from win),
dw as (select r, ws, size, unnest(range(1, len(ws) - size + 2)) as i from d, sizes where len(ws) >= size),
hit as (select r, i, size, item_id from (select r, i, size, array_to_string(ws[i:i + size - 1], ' ') as w from dw) join win using (size, w)),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from hit) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

OP8 = r"""
with d as (select row_number() over () as r, doc_id, source, string_split(text, chr(10)) as ls from documents),
l as (select r, doc_id, source, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
t as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as k from l),
s as (select k, min(doc_id) as first from t where k <> '' group by k having count(distinct source) >= 10),
x as (select t.*, s.k is not null and t.doc_id is distinct from s.first as gone from t left join s using (k)),
g as (select r, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text from x group by r)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(case when ls is not null then text end) as text_sha256
from d left join g using (r)
"""

#: The points of all slots, the sources they fall into, and the blocks that the ranked slots take of each source's stream.
OP10 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as u from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
k as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w, 3 * source_size as stop from s),
l as (select *, (sum(source_size) over () - coalesce(sum(stop) over o, 0))::double as rest, (sum(w) over () - coalesce(sum(w) over o, 0))::double as rest_w
  from k window o as (order by stop::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
m as (select *, stop * rest_w < w * rest as stops from l),
r as (select *, max(case when not stops then {'each': rest / rest_w, 'rest': rest, 'rest_w': rest_w} end) over () as f from m),
t as (select source, source_size, case when stops then stop::double else w * f.rest / f.rest_w end as target from r),
g as (select *, round(target)::bigint as goal from t),
z as (select sum(goal)::bigint as total, greatest(1, least(1048576, sum(source_size)::bigint // 262144)) as block from g),
c as (select *, (sum(goal) over (order by source nulls last rows unbounded preceding))::bigint as upto from g),
h as (select c.*, floor((upto - goal)::double / total::double * 2147483648::double)::bigint as lo, floor(upto::double / total::double * 2147483648::double)::bigint as hi from c, z),
n as (select unnest(range((total + block - 1) // block)) as slot from z),
x as (select slot, ((slot + 1) * 1327217885) % 2147483648 as x from n),
y as (select slot, source, row_number() over (partition by source order by slot) - 1 as rank from x join h on x.x >= h.lo and x.x < h.hi),
e as (select h.source, source_size, target, least(count(slot) * any_value(block), 3 * source_size)::bigint as upper from h cross join z left join y on h.source is not distinct from y.source group by h.source, source_size, target),
p as (select d.*, source_size, target, upper, (sum(size) over (partition by d.source order by u, doc_id, size rows unbounded preceding) - size)::bigint as start
  from d join e on d.source is not distinct from e.source),
q as (select *, k * source_size + start as a, least(k * source_size + start + size, upper) as b from p, (select unnest(range(3)) as k)),
v as (select source, start, doc_id, size, a, b, block, unnest(range(a // block, (b - 1) // block + 1)) as rank from q, z where b > a),
f as (select v.source, start, doc_id, size, sum(least(b, (v.rank + 1) * block) - greatest(a, v.rank * block))::bigint as taken, count(*) as n_slots, min(slot) as first_slot, max(slot) as last_slot
  from v join y on v.source is not distinct from y.source and v.rank = y.rank group by v.source, start, doc_id, size)
select p.doc_id, p.size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(n_slots, 0)::bigint as n_slots, first_slot::bigint as first_slot, last_slot::bigint as last_slot
from p left join f on p.size > 0 and p.source is not distinct from f.source and p.start = f.start and p.doc_id is not distinct from f.doc_id and p.size = f.size
"""

OP11 = r"""
with fold as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l),
d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents, fold),
w as (select r, lang, source, unnest(ts) as term from d),
k as (select lang, term from w group by lang, term having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
gn as (select lang, source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by lang, source),
ln as (select lang, sum(n) as total from c group by lang),
p as (select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) as p
  from g join k using (lang) join v using (lang) join gn using (lang, source) left join c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) as q from c join ln using (lang) join v using (lang) group by lang, term),
pv as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tm as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q),
x as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pr union all select * from tm))
select lang, source, part, item, value, rank::int as rank from x where part = 'pair' or rank <= 50
"""

#: CRC-32 bit by bit; equal words a period apart in unbroken stretches; of stretches with the same bounds the least period.
OP12 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
h as (select *, len(ws) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) as h from d),
a as (select r, doc_id, ws, n, h % 10 = 0 and n > 0 as planted, case when n > 0 then (h // 10) % n end as a, case when n > 0 then 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) end as p from h),
t as (select r, doc_id, n, case when planted then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end]) else ws end as ws from a),
w as (select r, n, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from t),
e as (select x.r, x.i, y.i - x.i as q from w x join w y on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
s as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from e),
m as (select r, q, min(i) as start, count(*) + q as length from s group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
u as (select r, start, length, min(q) as period from m group by r, start, length),
b as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from u group by r),
o as (select *, row_number() over (partition by r order by length::double / period desc, start, period) as best from u),
x as (select r, unnest(range(start + period, start + length)) as i from u),
k as (select w.r, string_agg(word, ' ' order by w.i) as text from w anti join x on w.r = x.r and w.i = x.i group by w.r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from t left join b using (r) left join (select * from o where best = 1) using (r) left join k using (r)
"""

ORACLES: dict[str, str] = {
    "op4_url_templates": urls.oracle(),
    "op5_benchmark_index": OP5,
    "op8_line_spread": OP8,
    "op9_repetition_rules": OP9,
    "op10_source_schedule": OP10,
    "op11_source_divergence": OP11,
    "op12_periodic_runs": OP12,
}
