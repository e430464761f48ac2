"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP7 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
pos as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as win from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
owners as (select win, min(doc_id) as owner from pos group by win),
hits as (select doc_id, i from pos join owners using (win) where doc_id > owner),
gone as (select distinct doc_id, i + k as j from hits, range(50) r(k)),
each_word as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as j from w),
kept as (select e.doc_id, string_agg(word, ' ' order by e.j) as t, count(*) as n from each_word e left join gone g on g.doc_id = e.doc_id and g.j = e.j where g.j is null group by 1)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""

OP8 = r"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
pos as (select doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from pos) where n >= 2),
rep as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from dup) group by doc_id),
lines as (select doc_id, (count(*) - count(distinct line))::bigint as n from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
base as (
  select w.doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from w left join lines using (doc_id) left join rep using (doc_id)),
failed as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from base),
hosts as (select source, count(*)::double as n, sum(base_failed::int)::double as f from failed group by source),
moments as (select sum(f) / sum(n) as m, greatest(sum(n * (f / n) * (f / n)) / sum(n) - pow(sum(f) / sum(n), 2), 0) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) as between_ from hosts),
prior as (select m, case when between_ > 1e-12 then least(greatest(m * (1 - m) / between_ - 1, 1), 1e6) else 1e6 end as k from moments),
bad as (select source, (f + m * k) / (n + k) > 0.5 as host_bad from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not host_bad) as kept
from failed join bad on failed.source is not distinct from bad.source
"""

OP9 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -1, k, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
esc as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\_') as er from rows),
sums as (
  select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text) as all_,
    coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10)))::bigint as formatted_chars
  from esc group by conv_id)
select conv_id, n_turns, sha256(all_) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from sums
"""

OP10 = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
g as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as top from d)
select page_id, payload_bytes, payload_digest, case when page_id < top then 'revisit' else 'response' end as record_type, case when page_id < top then top end as refers_to from g
"""

OP11 = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as bad from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(bad, false) as toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails
  from d left join l using (doc_id)),
cells as (select part, fails, count(*) as n, count(*) filter (where good) as ng, count(*) filter (where toxic) as nt from f group by all),
letters as (select unnest(range(1, 6)) as x),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, array_to_string(list_transform(o, lambda i: chr(64 + i::int)), '') as filter_order, unnest(range(1, 6))::int as step from orders),
marked as (
  select part, filter_order, step, o[step] as filter, n, ng, nt, fails[o[step]] as here, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 as earlier,
    len(list_filter(fails, lambda x: x)) = 1 as alone
  from cells, steps),
sums as (
  select part, filter_order, step, filter, coalesce(sum(n) filter (where not here and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (where here and not earlier), 0)::bigint as removed,
    coalesce(sum(n) filter (where here and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (where here and alone), 0)::bigint as unique_fails,
    coalesce(sum(ng) filter (where here and not earlier), 0)::bigint as good_lost, coalesce(sum(nt) filter (where here and not earlier), 0)::bigint as toxic_lost
  from marked group by part, filter_order, step, filter)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from sums
"""

OP12 = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') as units,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select doc_id, text, units, len(units)::bigint as n,
    [list_reduce(list_transform(string_split(substr(h, 8 * k + 1, 8), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b) for k in range(4)] as hs from t),
c as (
  select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 90 then 'plain' when hs[4] % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (
  select *, coalesce(array_to_string(units[1:a], ''), '') as prefix, coalesce(array_to_string(units[a + 1:b], ''), '') as middle, coalesce(array_to_string(units[b + 1:], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case when form = 'plain' then text else prefix || middle || suffix end) as restored_sha256
from p
"""

ORACLE: dict[str, str] = {"op7_substring_doubling": OP7, "op8_quality_hosts": OP8, "op9_chat_trees": OP9, "op10_warc": OP10, "op11_filter_audit": OP11, "op12_fill_middle": OP12}
