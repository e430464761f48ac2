"""DuckDB SQL for the library's registered queries."""

from __future__ import annotations

#: Words, folded lines and their links, as the operators define them.
_W = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
WORDS, LOWER_WORDS = _W.format("text"), _W.format("lower(text)")
LINE_ARRAY = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> '')"
LINES = f"lines as (select doc_id, source, lang, len(ls) as n_lines, md5(array_to_string(list_sort(ls), chr(10))) as set_id, unnest(ls) as line from (select doc_id, source, lang, list_distinct(list_filter({LINE_ARRAY}, lambda x: length(x) >= 8)) as ls from documents))"
#: The plain self-join of documents by their lines, then the candidates' copies counted together.
FOLDED = """joined as (select q.doc_id as q_id, c.doc_id as c, any_value(q.source) as q_source, any_value(q.lang) as module, any_value(c.source) as c_source, any_value(c.lang) as c_lang, any_value(c.set_id) as c_set,
  count(*) as hits, any_value(q.n_lines) as q_lines, any_value(c.n_lines) as c_lines from lines q join {c} where {asked} group by 1, 2),
folded as (select q_id, case when min(c) = q_id then max(c) else min(c) end as c_id, count(*) - count(*) filter (c = q_id) as c_copies, any_value(q_source) as q_source, any_value(module) as module, c_source, c_lang,
  any_value(hits) as hits, any_value(q_lines) as q_lines, any_value(c_lines) as c_lines, any_value(hits) / greatest(any_value(q_lines), any_value(c_lines))::double as line_sim
  from joined group by q_id, c_set, c_source, c_lang having count(*) > count(*) filter (c = q_id))"""
LINKS = f"""{LINES}, {FOLDED.format(c='lines c using (line)', asked='true')},
pairs as (select *, case when line_sim > 0.95 then 'confirmed' when line_sim >= 0.7 then 'review' when line_sim >= 0.5 then 'weak' end as tier from folded where line_sim >= 0.5),
rows_ as (select doc_id as q_id, lang as module, text from documents)"""
EXACT = """exact as (select q.doc_id as q_id, c.source, min(c.doc_id) as c_id from documents q join documents c on q.text = c.text and q.lang = c.lang and q.source <> c.source where q.doc_id % 50 = 0 group by 1, 2)"""
NAMES = rf"""named as (select doc_id, source, lang, coalesce(({LINE_ARRAY})[1], '') as name from documents),
names as (select q.doc_id as q_id, min(c.doc_id) as c_id, count(*) as c_copies from named q join named c on q.name = c.name and q.lang = c.lang and q.source <> c.source where q.doc_id % 50 = 0 and length(q.name) >= 5 group by q.doc_id, c.source)"""
RARE = f"""{LINES},
rare as (select line from lines group by line having count(distinct source) between 2 and 5),
{FOLDED.format(c='rare using (line) join lines c using (line)', asked='q.doc_id % 50 = 0')},
hits as (select q_id, c_id, c_copies, hits from folded where q_source <> c_source)"""
NORM = rf"list_filter(list_transform({LINE_ARRAY}, lambda x: trim(regexp_replace(x, '(//|#).*$', ''), ' ')), lambda x: x <> '')"
HASHED = rf"""hashed as (select doc_id, source, sha1(array_to_string({NORM}, chr(10))) as norm, sha1(coalesce(text, '')) as raw,
  case when len({WORDS}) >= 12 then sha1(array_to_string({WORDS}, ' ')) end as src, len({NORM}) as n_norm from documents)"""
COS = "list_cosine_similarity(q.embedding::double[], c.embedding::double[])"
TOPK = "select q_id, id, round(score, 5) as score, rank from (select q.vec_id as q_id, c.vec_id as id, {cos} as score, row_number() over (partition by q.vec_id order by {cos} desc, c.vec_id) as rank from embeddings q join embeddings c on q.vec_id <> c.vec_id and {on} where q.vec_id % 50 = 0) where rank <= {k}"
TOKENS = f"tokens as (select distinct doc_id, unnest({LOWER_WORDS}) as token from documents)"
WEIGHTS = f"{TOKENS}, idf as (select token, count(*) as df, ln((select count(*) from documents) / count(*)) as weight from tokens group by token)"
FPS = f"""{WEIGHTS},
votes as (select doc_id, round(weight * 1000)::bigint as w, ('0x' || substr(md5(token), 1, 15))::bigint as h from tokens join idf using (token)),
kept as (select * from votes where w > 0),
bits as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then w else -w end) as s from kept, range(60) r(b) group by 1, 2),
fps as (select doc_id, sum(case when s > 0 then 1::bigint << b::int else 0 end)::bigint as fp, any_value(n) as n_tokens from bits join (select doc_id, count(*) as n from kept group by 1) using (doc_id) group by 1)"""
CHANNELS = f"""{EXACT}, {NAMES},
near as (select q_id, id as c_id, score from ({TOPK.format(cos=COS, on='true', k=5)})),
all_ as (select q_id, c_id, score, 0 as k, 'vector' as s from near union all select q_id, c_id, 1.0, 1, 'fingerprint' from exact union all select q_id, c_id, 0.0, 2, 'name' from names),
united as (select q_id, c_id, arg_min(s, k) as recall_source, arg_min(score, k)::double as score, bool_or(s = 'vector') as vector_match, bool_or(s = 'fingerprint') as fingerprint_match, bool_or(s = 'name') as name_match from all_ group by 1, 2)"""
COMMITS = "commits as (select event_id as id, ts, user_id as grp, case when event_type <> 'error' then value end as size from events)"
JACCARD = "case when len(list_distinct(list_concat({a}, {b}))) = 0 then 0.5 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::double end"


def _jaccard(a: str, b: str) -> str:
    return JACCARD.format(a=a, b=b)


ORACLE: dict[str, str] = {
    "exact_fingerprint": f"with {EXACT} select * from exact",
    "file_identity_or": f"""with {HASHED},
met as (select q.doc_id as q_id, c.doc_id as c_id, (q.raw = c.raw or coalesce(q.src = c.src, false)) as verified from hashed q join hashed c on q.source <> c.source and (q.norm = c.norm or q.raw = c.raw or q.src = c.src) where q.doc_id % 50 = 0 and q.n_norm >= 5 and c.n_norm >= 5)
select q_id, count(*) as n_candidates, count(*) filter (verified) as n_verified, count(*) filter (not verified) as n_rejected from met group by 1""",
    "common_file_breadth": f"with {HASHED}, wide as (select norm, count(distinct source) as breadth from hashed group by 1) select doc_id, breadth, breadth >= 3 as is_common from hashed join wide using (norm)",
    "name_recall": f"with {NAMES} select * from names",
    "rare_string_hits": f"with {RARE} select * from hits",
    "pair_upsert": f"with {RARE}, {EXACT} select coalesce(e.q_id, h.q_id) as q_id, coalesce(e.c_id, h.c_id) as c_id, case when e.q_id is null then 0.0 else 1.0 end::double as score, coalesce(h.hits, 0) as hits, e.q_id is not null as known from exact e full join hits h on e.q_id = h.q_id and e.c_id = h.c_id",
    "token_idf": f"with {WEIGHTS} select token, df, round(weight, 6) as weight from idf",
    "shingles_4": f"""with w as (select doc_id, {LOWER_WORDS} as w from documents),
s as (select doc_id, case when len(w) >= 12 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], chr(31))) else [] end as s from w)
select doc_id, len(s)::int as n_shingles, len(list_distinct(s))::int as n_distinct from s""",
    "simhash_fingerprint": f"with {FPS} select doc_id, fp, n_tokens from fps",
    "simhash_neighbors_15": f"with {FPS} select q.doc_id as q_id, c.doc_id, bit_count(xor(q.fp, c.fp))::int as distance from fps q join documents dq on dq.doc_id = q.doc_id, fps c join documents dc on dc.doc_id = c.doc_id where q.doc_id % 50 = 0 and q.doc_id <> c.doc_id and dq.lang = dc.lang and bit_count(xor(q.fp, c.fp)) <= 15 and least(q.n_tokens, c.n_tokens) >= 0.45 * greatest(q.n_tokens, c.n_tokens)",
    "vector_topk_filtered": TOPK.format(cos=COS, on="q.label <> c.label", k=20),
    "pool_topk": TOPK.format(cos=COS, on="q.label = c.label", k=5),
    "baseline_argmax": f"select q_id, id as baseline_id, round(score, 5) as score, score > 0.35 as derived from (select q.vec_id as q_id, c.vec_id as id, {COS} as score, row_number() over (partition by q.vec_id order by {COS} desc, c.vec_id) as rank from embeddings q join embeddings c on q.label <> 0 and c.label = 0) where rank = 1",
    "similarity_bins": f"with t as ({TOPK.format(cos=COS, on='true', k=20)}) select bin, count(*) as n from (select case when score > 0.45 then 0.45 when score > 0.4 then 0.4 when score > 0.35 then 0.35 when score > 0.3 then 0.3 end::double as bin from t) where bin is not null group by 1",
    "recall_union_provenance": f"with {CHANNELS} select * from united",
    "retrieval_funnel": f"with {CHANNELS} select channel, count(*) filter (recall_source = channel) as n_first, count(*) filter (found) as n_found from (select recall_source, unnest([{{'channel': 'vector', 'found': vector_match}}, {{'channel': 'fingerprint', 'found': fingerprint_match}}, {{'channel': 'name', 'found': name_match}}], recursive := true) from united) group by 1",
    "identity_score": rf"""with {LINKS}, side as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) as name,
  length(name) - length(replace(name, ',', '')) as params, list_distinct(list_filter(w, lambda x: length(x) >= 8)) as behavior, list_intersect(w, ['and','or','of','in','to','que','und','et','de']) as control
  from (select doc_id, coalesce(({LINE_ARRAY})[1], '') as name, {LOWER_WORDS} as w from documents))
select q_id, c_id, round(0.45 * case when list_sort(q.name) = list_sort(c.name) and array_to_string(q.name, ' ') = array_to_string(c.name, ' ') then 1.0 else {_jaccard('q.name', 'c.name')} end + 0.20 * (1.0 / (1.0 + abs(q.params - c.params))) + 0.25 * {_jaccard('q.behavior', 'c.behavior')} + 0.10 * {_jaccard('q.control', 'c.control')}, 4) as identity
from pairs join side q on q.doc_id = q_id join side c on c.doc_id = c_id""",
    "tier_counts": f"with {LINKS} select tier, count(*) as n, sum(c_copies)::bigint as n_documents from pairs group by 1",
    "segment_selection": f"""with {LINKS}, best as (select q_id, c_source, max((line_sim, hits)) as b, min(c_id) as f from pairs group by 1, 2),
ranked as (select q_id, c_source, row_number() over (partition by q_id order by b desc, f) as content_rank from best)
select q_id, c_id, content_rank::int as content_rank, case when content_rank <= 2 then 'selected' else 'deferred_secondary' end as state from pairs join ranked using (q_id, c_source)""",
    "dominated_suppression": f"with {LINKS} select q_id, c_id, (max(line_sim) over (partition by q_id) >= 0.5 and max(line_sim) over (partition by q_id) - line_sim >= 0.18 and line_sim < 0.7 and coalesce(tier, '') <> 'confirmed') as dominated from pairs",
    "widespread_annotation": f"with {LINKS} select q_id, count(distinct case when tier = 'confirmed' or line_sim >= 0.9 then c_source end) as n_sources, count(distinct case when tier = 'confirmed' or line_sim >= 0.9 then c_source end) >= 5 as widespread from pairs group by 1",
    "baseline_propagation": f"""with {LINKS}, bench as (select distinct unnest({LINE_ARRAY}) as line from benchmark), known as (select distinct doc_id from lines join bench using (line))
select q_id, c_id, bool_or(k.doc_id is not null) over (partition by q_id) as baseline from pairs left join known k on k.doc_id = c_id""",
    "submodule_rollup": f"""with {LINKS}, cat as (select q_id, d.module, min(case p.tier when 'confirmed' then 0 when 'review' then 1 when 'weak' then 2 else 3 end) as k from rows_ d left join pairs p using (q_id) group by 1, 2)
select module, count(*) as total, count(*) filter (k = 0) as n_confirmed, count(*) filter (k = 1) as n_review, count(*) filter (k = 2) as n_weak, count(*) filter (k = 3) as n_none,
  round(100.0::double * count(*) filter (k = 0) / count(*), 3) as share_confirmed, round(100.0::double * count(*) filter (k = 1) / count(*), 3) as share_review, round(100.0::double * count(*) filter (k = 2) / count(*), 3) as share_weak, round(100.0::double * count(*) filter (k = 3) / count(*), 3) as share_none from cat group by 1""",
    "undetected": f"with {LINKS} select q_id, length(text)::bigint as size from rows_ where q_id not in (select q_id from pairs)",
    "source_metrics_rank": f"""with {LINKS}, best as (select q_id, c_source, max((line_sim, hits, module)) as b from pairs where q_source <> c_source group by 1, 2), sh as (select q_id, count(*) > 1 as shared from best group by 1),
m as (select c_source, count(*) as functions, sum(b[2])::bigint as lines, count(distinct b[3]) as modules, count(*) filter (shared) as shared_functions from best join sh using (q_id) group by 1)
select *, row_number() over (order by functions desc, lines desc, modules desc, shared_functions, c_source)::int as rank from m""",
    "exclusive_exclusions": f"""with {LINKS}, r as (select q_id, case when q_source = c_source then 0 end as a, case when module <> c_lang then 1 end as b, case when hits < 2 then 2 end as c from pairs), inc as (select distinct q_id from pairs where q_source <> c_source and module = c_lang and hits >= 2),
f as (select q_id, least(min(a), min(b), min(c)) as k from r where q_id not in (select q_id from inc) group by 1)
select ['internal', 'cross_language', 'thin'][k + 1] as reason, count(*) as functions from f where k is not null group by 1""",
    "overview_reconcile": f"""with {LINKS}, b as (select q_id, bool_or(q_source <> c_source and module = c_lang and hits >= 2) as s from pairs group by 1)
select count(*) filter (s) as similar, count(*) filter (not s) as excluded, count(*) filter (s is null) as none, count(*) as total, true as reconciled from rows_ left join b using (q_id)""",
    "file_line_coverage": f"""with {LINES}, o as (select line, min(doc_id) as c_id from lines group by 1), m as (select l.doc_id, l.n_lines, case when l.doc_id > c_id then d.source end as s from lines l join o using (line) join documents d on d.doc_id = c_id),
n as (select doc_id, any_value(n_lines) as n_lines, s, count(*) as n from m group by doc_id, s)
select doc_id, any_value(n_lines)::int as n_lines, coalesce(sum(n) filter (s is not null), 0)::bigint as covered, arg_max(s, (n, s)) filter (s is not null) as top_source, round(coalesce(sum(n) filter (s is not null), 0) / any_value(n_lines)::double, 6) as coverage from n group by 1""",
    "cluster_priority": f"""with {LINKS}, g as (select c_source, module, count(distinct q_id) as functions, sum(hits)::bigint as lines, avg(line_sim) as mean_sim, count(distinct q_source) as sources from pairs group by 1, 2),
p as (select *, 100 * (0.5::double * mean_sim + 0.15::double + 0.2::double * least(1.0, lines / 300.0::double)) - least(18, greatest(0, sources - 2) * 2) as x from g)
select c_source, module, functions, lines, round(mean_sim, 6) as mean_sim, sources, round(x, 4) as priority, case when x >= 78 then 'high' when x >= 62 then 'medium' else 'low' end as level from p""",
    "module_classifier": f"""with rules as (select * from (values ('core', 0, ['the', 'der', 'les', 'los']), ('link', 1, ['and', 'und', 'et', 'y']), ('place', 2, ['in', 'on', 'en', 'dans'])) v(module, ordinal, ks)),
w as (select doc_id, lower(source) as p, {LOWER_WORDS} as w, list_transform({LINE_ARRAY}, lambda x: split_part(lower(x), ' ', 1)) as heads from documents), n as (select doc_id, module, ordinal, len(list_intersect(ks, regexp_split_to_array(p, '[^a-z0-9]+'))) as a, len(list_intersect(ks, heads)) as b, len(list_intersect(ks, w)) as c from w, rules),
s as (select doc_id, module, ordinal, least(11, 7 * a) + least(13, 10 * b) + least(8, 2 * c) as pts from n where a + b + c > 0), best as (select doc_id, arg_max(module, (pts, -ordinal)) as module, max(pts) as pts from s group by 1)
select doc_id, coalesce(module, 'other') as module, coalesce(pts, 0)::bigint as points from documents left join best using (doc_id)""",
    "regex_evidence_scan": r"""with p as (select * from (values ('amount', '[0-9]{3}'), ('email', '[a-z0-9.]+@[a-z0-9.]+'), ('symbol', '[#$%&]{3}')) v(category, pattern)),
n as (select doc_id, category, len(regexp_extract_all(coalesce(text, ''), pattern)) as n, string_split_regex(coalesce(text, ''), pattern)[1] as before from documents, p)
select doc_id, category, n::int as n, (length(before) - length(replace(before, chr(10), '')) + 1)::int as first_line from n where n > 0""",
    "html_visible_text": r"""with a as (select page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style|code|pre)\b[^>]*>.*?</(script|style|code|pre)>', ' ', 'g') as t from pages),
b as (select page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&hellip;', '…'), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as t from b)
select page_id, md5(t) as text_md5, length(t)::int as n_chars from c""",
    "url_identity": r"""with i as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '^[^/@]*@', ''), '^([^/:]+):[0-9]+', '\1'), '/+$', ''), '\.git$', '') as identity from pages)
select page_id, identity, substr(trim(regexp_replace(identity, '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) || '-' || substr(sha256(identity), 1, 24) as storage_key from i""",
    "full_text_search": r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as line from documents)
select doc_id, line::int as line from l where list_has_all(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+'), ['the', 'and', 'of'])""",
    "call_chain": """with recursive n as (select user_id, ts, event_id, event_type || ':' || user_id as caller from events), e0 as (select caller, lead(caller) over w as callee, row_number() over w as k from n window w as (partition by user_id order by ts, event_id)),
e as (select distinct caller, callee from e0 where callee is not null),
r(root, node, depth) as (select caller, caller, 0 from e0 where k = 1 union select root, callee, depth + 1 from r join e on node = caller where depth < 5)
select root, node, min(depth)::int as depth from r group by 1, 2""",
    "reference_full_outer": f"""with n as (select doc_id, source, coalesce(({LINE_ARRAY})[1], '') as name from documents), q as (select source, name, min(doc_id) as q_id from n where source <> 'src0' and length(name) >= 5 group by 1, 2), r as (select name, min(doc_id) as r_id from n where source = 'src0' and length(name) >= 5 group by 1)
select q.source, coalesce(q.name, r.name) as name, q_id, r_id, case when q_id is null then 'reference_only' when r_id is null then 'current_only' else 'both' end as state from q full join r on q.name = r.name""",
    "large_commit_threshold": f"""with {COMMITS}, k as (select grp, count(*) as n, count(*) filter (size is null) as n_unknown, case when count(*) filter (size > 0) >= 8 then greatest(100.0, ceil(median(size) filter (size > 0) * 2)) else 100.0 end::double as threshold from commits group by 1)
select grp, any_value(n) as n, any_value(n_unknown) as n_unknown, round(any_value(threshold), 4) as threshold, count(*) filter (size >= threshold) as n_large from commits join k using (grp) group by 1""",
    "close_large_pairs": f"""with {COMMITS}, l as (select grp, id, ts, lead(id) over w as next_id, lead(ts) over w as next_ts from commits where size >= 50 window w as (partition by grp order by ts, id))
select grp, id, next_id from l where next_id is not null and epoch_us(next_ts) - epoch_us(ts) between 0 and 24 * 3600000000""",
    "stage_ranges": f"""with {COMMITS}, s as (select *, row_number() over (partition by grp order by ts, id) - 1 as seq, count(*) over (partition by grp) as n from commits)
select grp, (seq // 10)::int as stage, (min(seq) // 10 * 10)::int as start, least(min(seq) // 10 * 10 + 9, any_value(n) - 1)::int as stop, count(*) as n, round(sum(size), 2) as size, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day from s group by 1, 2""",
    "coverage_audit": "select 'src' || r.i as source, count(doc_id) as n, count(doc_id) > 0 as covered from range(25) r(i) left join documents on source = 'src' || r.i group by 1",
    "catalog_search": "select c_custkey, c_name from customer where lower(c_name) like '%urgent%' or lower(c_mktsegment) like '%urgent%' or exists (select 1 from orders where o_custkey = c_custkey and lower(o_orderpriority || ' ' || o_orderstatus) like '%urgent%')",
    "catalog_jobs": "select c_custkey, c_name, (select strftime(max(o_orderdate), '%Y-%m-%d') from orders where o_custkey = c_custkey) as last_day, (select count(*) from orders where o_custkey = c_custkey) as n_jobs from customer",
    "missing_reports": "select c_custkey, kind from customer, (values ('F'), ('O')) v(kind) where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = kind)",
    "eval_recall_precision": f"""with s as (select lang as cls, quality as label, len({WORDS}) >= 100 as hit from labels join documents using (doc_id))
select cls, count(*) as n, round(avg(hit::int), 6) as recall, null::double as precision from s where label = 1 group by 1
union all select 'all', count(*) filter (label = 1), round(count(*) filter (hit and label = 1) / count(*) filter (label = 1)::double, 6), round(count(*) filter (hit and label = 1) / count(*) filter (hit)::double, 6) from s""",
    "module_distribution": "select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1, 2",
}
ORACLE["closest_source"] = f"select * from ({ORACLE['source_metrics_rank']}) where rank = 1"
