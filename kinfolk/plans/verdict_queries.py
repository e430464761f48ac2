"""Registered queries of scores, verdicts, reviews, paths and lines, with their DuckDB SQL.

The evidence of a pair of documents comes from their lines; where the library's functions ask for evidence that documents
have not (names, literals, segments), numbers derived from their counts of lines stand for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions import paths
from kinfolk.functions import scores as S
from kinfolk.functions import text as X
from kinfolk.operators import contracts, history, recall, review, search, selection, verdicts
from kinfolk.plans.oracle import LINE_ARRAY, LINKS, LOWER_WORDS
from kinfolk.plans.queries import asked, links_of, pairs_of, table, tiered
from kinfolk.runtime import sized_join, stored


def evidence(spark, sf_dir) -> DataFrame:
    return evidence_of(pairs_of(spark, sf_dir))


def evidence_of(pairs: DataFrame) -> DataFrame:
    rows = pairs.withColumnRenamed("hits", "matched")
    rows = rows.withColumn("identity", F.least(F.lit(1.0), F.col("line_sim") + (F.col("q_lines") % 3) / 20)).withColumn("literals", (F.col("matched") % 4).cast("int")).withColumn("segment_cover", F.col("line_sim") / 2)
    rows = rows.withColumn("fingerprint", F.col("line_sim") == 1).withColumn("content", F.col("c_source")).withColumn("cover", verdicts.match_cover(F.col("matched"), F.col("q_lines"), F.col("c_lines")))
    return rows.withColumn("relation", review.identity_relation((F.col("q_lines") + F.col("c_lines")) % 2 == 0, F.col("identity"), F.col("line_sim")))


def pair_scores(spark, sf_dir):
    """The scores and small verdicts of every pair."""
    e = evidence(spark, sf_dir)
    line, matched, q, c = F.col("line_sim"), F.col("matched"), F.col("q_lines"), F.col("c_lines")
    score = S.segment_rescore(F.col("cover"), F.col("segment_cover"), line, F.col("identity"))
    priority = S.review_priority(line, F.lit(0.5), matched, F.when(F.col("fingerprint"), 1.0).otherwise(0.3))
    return e.select(
        "q_id",
        "c_id",
        F.round(S.structural_score(matched % 64), 6).alias("structural"),
        F.round(score, 4).alias("segment_score"),
        S.retier(F.col("tier"), score, F.col("segment_cover"), line).alias("retier"),
        S.incremental(line, matched, F.col("segment_cover"), q - 4).alias("incremental"),
        S.substantive_baseline(F.lit(False), line, matched).alias("substantive"),
        S.baseline_derived(F.col("q_source") == F.col("c_source"), F.col("identity"), line).alias("derived"),
        F.round(S.pairing_score(F.col("identity"), line, F.col("fingerprint")), 6).alias("pairing"),
        S.clone_kind(matched, F.greatest(q - matched, F.lit(0))).alias("kind"),
        F.round(priority, 4).alias("priority"),
        S.priority_level(priority, 78, 62).alias("level"),
        S.vector_gate(line - 0.2, F.col("fingerprint")).alias("gate"),
        S.length_ratio_ok(q, c).alias("like_size"),
        S.identity_rescued(F.col("identity"), F.col("segment_cover"), matched).alias("rescued"),
        S.rescued_tier(F.nullif(F.col("tier"), F.lit("weak")), F.col("literals") == 3, F.col("literals") == 2, F.col("identity") > 0.6).alias("rescued_tier"),
        verdicts.effective_lines(matched - 2, line, q).alias("effective"),
        F.round(verdicts.line_similarity(F.when(q > 5, line), hits=matched, q_lines=q, c_lines=c), 6).alias("first_known"),
        verdicts.partial_match(matched, q, c).alias("partial"),
    )


def review_admission(spark, sf_dir):
    """Which pairs come to a review, on what ground, and which of each query's contents goes first; a line counts as four, as
    lines of prose are long."""
    links = links_of(spark, sf_dir)

    def admitted(more=None):
        rows = evidence_of(tiered(links.pairs(more))).withColumn("excluded", F.col("q_source") == F.col("c_source")).withColumns({c: F.col(c) * 4 for c in ("matched", "q_lines", "c_lines")})
        needed = ["q_id", "c_id", "tier", "relation", "excluded", "q_lines", "c_lines", "matched", "line_sim", "segment_cover", "identity", "literals", "fingerprint", "content", *(["states"] if more is not None else [])]
        # no ground holds for fewer lines; exploded as one row, as the grounds name every column many times
        rows = rows.filter(F.col("matched") >= review.LEAST_MATCHED).select(F.explode(F.array(F.struct(*needed))).alias("x")).select("x.*")
        return review.admission(rows, least_lines=3)

    states = stored(review.content_states(admitted()), "states")
    return review.by_content_states(admitted(states)).select("q_id", "c_id", "relation", "basis", "review_score", "state")


def contested_pairs(spark, sf_dir):
    rows = verdicts.contested(evidence(spark, sf_dir).withColumn("agrees", F.col("module") == F.col("c_lang")))
    return rows.select("q_id", "c_id", "overrides", "needs_human", verdicts.holds(verdicts.SECONDARY).alias("secondary"))


def secondary_fallbacks(spark, sf_dir):
    """Where all selected pairs of a query were cleared (here: all of them), the deferred pair that takes their place."""
    queue = evidence(spark, sf_dir).withColumn("review_score", F.round(F.col("line_sim"), 3)).withColumn("state", F.when(F.col("literals") == 0, "selected").otherwise("deferred_secondary"))
    queue = stored(queue, "queue")
    cleared = queue.filter("state = 'selected' and q_id % 3 <> 0").select("q_id", "c_id", F.lit("cleared").alias("verdict"))
    return verdicts.secondary_fallback(queue, cleared)


def best_sources(spark, sf_dir):
    """The sources of confirmed pairs of every document, the most similar first."""
    out = verdicts.best_source(evidence(spark, sf_dir), F.col("tier") == "confirmed", "sources")
    return out.select("q_id", F.array_join("sources", ",").alias("sources"), "best", F.round("similarity", 6).alias("similarity"))


def source_history(spark, sf_dir):
    rows = stored(evidence(spark, sf_dir).withColumnRenamed("matched", "hits").select("q_id", "c_source", "hits", "module", "tier", "fingerprint"), "history")
    files = rows.filter("fingerprint").select(F.col("q_id").alias("path"), "c_source")
    return verdicts.history_metrics(rows.filter("tier = 'confirmed'"), rows.filter("tier <> 'confirmed'"), files)


def top_candidates(spark, sf_dir):
    out = review.top_candidates(evidence(spark, sf_dir), "line_sim", 3)
    return out.select("q_id", F.array_join(F.transform("candidates", lambda x: x["c_id"].cast("string")), ",").alias("candidates"))


def known_contents(spark, sf_dir):
    """Pairs of a content that another pair of the same query confirms."""
    links = links_of(spark, sf_dir)
    known = stored(selection.confirmed_contents(evidence_of(tiered(links.pairs()))), "known")
    return evidence_of(tiered(links.pairs(known))).select("q_id", "c_id", selection.promoted(F.col("known")).alias("promoted"))


def skipped_documents(spark, sf_dir):
    """Documents with an exact copy in another source leave the pairs: what is left, with the texts' lengths."""
    docs = table(spark, sf_dir, "documents")
    same = docs.groupBy(F.sha2("text", 256).alias("fp")).agg(F.count_distinct("source").alias("n")).filter("n > 1").select("fp")
    skipped = stored(sized_join(docs.select("doc_id", F.sha2("text", 256).alias("fp")), stored(same, "copied"), "fp", "left_semi").select(F.col("doc_id").alias("q_id")), "skipped")
    left = sized_join(pairs_of(spark, sf_dir).select("q_id", "c_id"), skipped, "q_id", "left_anti")
    size = docs.select(F.col("doc_id").alias("c_id"), F.length("text").cast("long").alias("c_chars"))
    return left.join(size, "c_id").select("q_id", "c_id", "c_chars")


def open_groups(spark, sf_dir):
    """Sources and modules that are to be reviewed and that nothing has confirmed, each once."""
    rows = pairs_of(spark, sf_dir)
    confirmed = stored(rows.filter("tier = 'confirmed'").select("c_source", "module").distinct(), "confirmed")
    return sized_join(rows.filter("tier <> 'confirmed'").select("c_source", "module").distinct(), confirmed, ["c_source", "module"], "left_anti")


def path_predicates(spark, sf_dir):
    """What addresses of pages say, taken for paths of files."""
    bare = F.replace(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.lit("."), F.lit("/"))
    p = F.concat(bare, F.lit("/"), F.when(F.col("page_id") % 4 == 0, "latest/a.rs").when(F.col("page_id") % 4 == 1, "my-test.d/b.c").when(F.col("page_id") % 4 == 2, "riscv-elf-cross/c.S").otherwise("net/bench_x.h"))
    rows = table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    return rows.select("page_id", paths.language(F.col("p")).alias("lang"), paths.is_test_path(F.col("p")).alias("is_test"), paths.is_excluded(F.col("p")).alias("is_excluded"), paths.has_segments(F.col("p"), F.lit("example/com")).alias("in_com"))


def line_search(spark, sf_dir):
    """Lines of documents of some sources (by a glob) that match a pattern."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), "text")
    return search.search_lines(files, r"[0-9]{2}[^ ]* [A-Za-z]", "src1?/*n").select("doc_id", "line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def calls_of(spark, sf_dir) -> DataFrame:
    """Events as calls: each user's event calls the next one; the kind of event is the folder."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat("event_type", F.lit("/u"), (F.col("user_id") % 9).cast("string"), F.lit(".c")).alias("file"), F.concat(F.substring("event_type", 1, 2), F.lit("_"), (F.col("event_id") % 40).cast("string")).alias("name"))
    nxt = F.lead("name").over(history.W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.withColumn("callee", nxt).filter("callee is not null").select("file", F.col("name").alias("caller"), "callee")


def symbol_references(spark, sf_dir):
    """Where the functions pu_0 to pu_9 are called from, by folder."""
    calls = calls_of(spark, sf_dir).filter(F.col("callee").rlike("^pu_[0-9]$"))
    return search.references(calls, F.split("file", "/")[0])


def subtree_edges(spark, sf_dir):
    """Calls inside the folder of clicks, into it and out of it."""
    return search.subtree_edges(calls_of(spark, sf_dir), "click/")


def evidence_rules(spark, sf_dir):
    """Stages and key events of users against the rules of a development report; every event of more than 400 must be told."""
    commits = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.row_number().over(history.W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"))
    commits = stored(commits, "development")
    reviews = commits.filter("value > 300 and event_id % 11 <> 0").select("user_id", "event_id").unionByName(commits.filter("value > 300 and event_id % 13 = 0").select("user_id", "event_id"))
    stages = commits.filter("seq % 25 = user_id % 2").select("user_id", (F.col("seq") / 25).cast("int").alias("stage"), F.col("seq").alias("start"), (F.col("seq") + 30).alias("key"))
    return contracts.development_violations("user_id", commits.filter("value > 300").select("user_id", "event_id", (F.col("value") > 400).alias("must")), reviews, stages, commits.groupBy("user_id").agg(F.max("seq").alias("last")))


QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        pair_scores, review_admission, contested_pairs, secondary_fallbacks, best_sources, source_history, top_candidates,
        known_contents, skipped_documents, open_groups, path_predicates, line_search, symbol_references, subtree_edges, evidence_rules,
    )
}

_E = f"""{LINKS},
e0 as (select q_id, c_id, q_source, c_source, module, c_lang, tier, hits as matched, q_lines, c_lines, line_sim, least(1.0::double, line_sim + (q_lines % 3) / 20.0::double) as identity, (hits % 4)::int as literals, line_sim / 2 as segment_cover,
  line_sim = 1 as fingerprint, c_source as content, least(1.0::double, hits / greatest(least(q_lines, c_lines), 1)::double) as cover from pairs),
e as (select *, case when (q_lines + c_lines) % 2 = 0 then case when identity >= 0.62 then 'exact_counterpart' when line_sim >= 0.7 then 'same_name_code_clone' else 'same_name_only' end
  else case when identity >= 0.72 then 'compatible_renamed' when line_sim >= 0.7 then 'code_clone_renamed' else 'family_neighbor' end end as relation from e0)"""
_COUNTERPART = "relation in ('exact_counterpart', 'same_name_code_clone')"
_PATHS = "p as (select page_id, lower(replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '.', '/') || '/' || ['latest/a.rs', 'my-test.d/b.c', 'riscv-elf-cross/c.S', 'net/bench_x.h'][page_id % 4 + 1]) as p from pages), q as (select *, list_filter(string_split(p, '/'), lambda x: x not in ('', '.', '..')) as parts from p)"
_IS_TEST = f"(x in {paths.TEST_NAMES} or list_has_any(regexp_split_to_array(x, '[-_.]+'), {list(paths.TEST_WORDS)}))"
_CALLS = "n as (select user_id, ts, event_id, event_type || '/u' || user_id % 9 || '.c' as file, substr(event_type, 1, 2) || '_' || event_id % 40 as name from events), c as (select * from (select file, name as caller, lead(name) over (partition by user_id order by ts, event_id) as callee from n) where callee is not null)"

ORACLE: dict[str, str] = {
    "pair_scores": f"""with {_E}, s as (select *, least(1.0, greatest(0.0, 0.4::double * least(cover, segment_cover) + 0.3::double * line_sim + 0.3::double * identity)) as sc, 100 * (0.45::double * line_sim + 0.125::double + 0.2::double * least(1.0, matched / 80.0::double) + 0.1::double * case when fingerprint then 1.0 else 0.3 end) as pr,
  greatest(q_lines - matched, 0) as ren from e)
select q_id, c_id, round(1 - (matched % 64) / 64.0::double, 6) as structural, round(sc, 4) as segment_score, case when tier = 'weak' and sc > 0.75 then 'review' when tier = 'review' and segment_cover < 0.3 and line_sim < 0.2 then 'dismissed' else tier end as retier,
  line_sim >= segment_cover + 0.1::double and matched >= q_lines - 4 + 3 as incremental, line_sim >= 0.5 and matched >= 3 as substantive, (q_source = c_source and identity > 0.75 and line_sim > 0.75) or identity > 0.9 as derived,
  round(0.45::double * identity + 0.35::double * line_sim + 0.2::double * fingerprint::int, 6) as pairing, case when ren = 0 then 'exact' when ren / (matched + ren)::double <= 0.15 then 'near_dup' else 'similar' end as kind, round(pr, 4) as priority,
  case when pr >= 78 then 'high' when pr >= 62 then 'medium' else 'low' end as level, line_sim - 0.2::double > 0.7 or fingerprint as gate, least(q_lines, c_lines) >= 0.45 * greatest(q_lines, c_lines) as like_size, identity >= 0.62 and segment_cover >= 0.15 and matched >= 3 as rescued,
  coalesce(nullif(tier, 'weak'), case when literals = 3 then 'review' when literals = 2 then 'weak' when identity > 0.6 then 'weak' end) as rescued_tier,
  least(q_lines, coalesce(case when matched - 2 > 0 then matched - 2 end, round(line_sim * q_lines)))::bigint as effective, round(coalesce(case when q_lines > 5 then line_sim end, matched / greatest(q_lines, c_lines)::double), 6) as first_known,
  matched >= 5 and least(q_lines, c_lines) > 0 and matched / least(q_lines, c_lines)::double >= 0.35 as partial from s""",
    "review_admission": f"""with {_E}, e4 as (select * replace (matched * 4 as matched, q_lines * 4 as q_lines, c_lines * 4 as c_lines) from e), o as (select *, {_COUNTERPART} as counterpart, tier in ('review', 'weak') and q_source <> c_source and relation not in ('family_neighbor', 'same_name_only', 'nonsemantic_stub') and least(q_lines, c_lines) >= 3 as open_ from e4),
a as (select *, case when not open_ then null
  when fingerprint and matched >= 6 and (line_sim >= 0.35 or segment_cover >= 0.4 or identity >= 0.7) then 'normalized_fingerprint_with_code_support' when line_sim >= 0.6 and matched >= 6 then 'strong_bilateral_line_similarity'
  when line_sim >= 0.45 and matched >= 8 and cover >= 0.5 and (segment_cover >= 0.5 or identity >= 0.7 or literals >= 2 or fingerprint) then 'multi_signal_code_similarity'
  when counterpart and line_sim >= 0.35 and matched >= 15 and cover >= 0.4 and identity >= 0.8 then 'identity_supported_large_partial_match'
  when line_sim >= 0.4 and matched >= 12 and cover >= 0.55 and segment_cover >= 0.5 and identity >= 0.75 then 'supported_substantive_partial_match' end as basis,
  round_even(least(1.0, 0.5::double * line_sim + 0.18::double * segment_cover + 0.14::double * cover + 0.1::double * identity + 0.05::double * least(1.0, matched / 20.0::double) + 0.03::double * least(1.0, literals / 3.0::double) + 0.05::double * fingerprint::int), 4) as review_score from o),
d as (select * from a where basis is not null),
b as (select q_id, content, max(review_score) as s, bool_or(fingerprint) as f from d group by 1, 2),
r as (select *, f or s >= max(s) over (partition by q_id) - 0.03 as near, row_number() over (partition by q_id order by s desc, content) as r from b)
select q_id, c_id, relation, basis, review_score, case when near and r <= 1 then 'selected' else 'deferred_secondary' end as state from d join r using (q_id, content)""",
    "contested_pairs": f"""with {_E}, o as (select *, tier in ('review', 'weak') and module = c_lang and {_COUNTERPART} as open_ from e)
select q_id, c_id, open_ and ((line_sim >= 0.85 and cover >= 0.75 and matched >= 8) or (line_sim >= 0.7 and cover >= 0.85 and matched >= 10)) as overrides,
  open_ and (fingerprint or (line_sim >= 0.6 and matched >= 10) or (line_sim >= 0.35 and matched >= 15 and identity >= 0.8)) as needs_human, fingerprint or (literals >= 1 and line_sim >= 0.55 and matched >= 8 and cover >= 0.5) as secondary from o""",
    "secondary_fallbacks": f"""with {_E}, q as (select *, round(line_sim, 3) as review_score from e),
sel as (select q_id, bool_and(q_id % 3 <> 0) as cleared from q where literals = 0 group by 1),
strong as (select q.* from q join sel using (q_id) where cleared and literals <> 0 and (fingerprint or (literals >= 1 and line_sim >= 0.55 and matched >= 8 and cover >= 0.5)
  or ({_COUNTERPART} and ((line_sim >= 0.85 and matched >= 8 and cover >= 0.6) or (line_sim >= 0.65 and matched >= 12 and cover >= 0.6)))
  or (not {_COUNTERPART} and segment_cover > 0 and line_sim >= 0.7 and matched >= 12 and cover >= 0.6 and identity >= 0.8)))
select q_id, (list(c_id order by review_score desc, c_id))[1] as c_id from strong group by 1""",
    "best_sources": f"""with {_E}, b as (select q_id, c_source, max(line_sim) as s from e where tier = 'confirmed' group by 1, 2)
select q_id, string_agg(c_source, ',' order by s desc, c_source) as sources, (list(c_source order by s desc, c_source))[1] as best, round(max(s), 6) as similarity from b group by 1""",
    "source_history": f"""with {_E}, c as (select * from e where tier = 'confirmed'), one as (select c_source, count(distinct q_id) as functions, sum(matched)::bigint as lines, count(distinct module) as modules from c group by 1),
two as (select c_source, count(distinct q_id) as reviewed from (select q_id, c_source from e where tier <> 'confirmed' except select q_id, c_source from c) group by 1), three as (select c_source, count(distinct q_id) as equal_files from e where fingerprint group by 1),
o as (select c_source, coalesce(functions, 0) as functions, coalesce(lines, 0) as lines, coalesce(modules, 0) as modules, coalesce(reviewed, 0) as reviewed, coalesce(equal_files, 0) as equal_files from one full join two using (c_source) full join three using (c_source))
select *, row_number() over (order by functions desc, lines desc, modules desc, reviewed desc, equal_files desc, c_source)::int as rank from o""",
    "top_candidates": f"""with {_E}, r as (select q_id, c_id, row_number() over (partition by q_id order by line_sim desc, c_id) as r from e) select q_id, string_agg(c_id::varchar, ',' order by r) as candidates from r where r <= 3 group by 1""",
    "known_contents": f"""with {_E} select q_id, c_id, coalesce(bool_or(tier = 'confirmed') over (partition by q_id, content) and tier <> 'confirmed', false) as promoted from e""",
    "skipped_documents": f"""with {LINKS}, s as (select doc_id from documents where text in (select text from documents group by text having count(distinct source) > 1))
select q_id, c_id, length(d.text)::bigint as c_chars from pairs join documents d on d.doc_id = c_id where q_id not in (select doc_id from s)""",
    "open_groups": f"""with {LINKS} select distinct c_source, module from pairs where tier <> 'confirmed' except select c_source, module from pairs where tier = 'confirmed'""",
    "path_predicates": f"""with {_PATHS}
select page_id, ['rust', 'c', 'asm', 'c'][page_id % 4 + 1] as lang, len(list_filter(parts[:-2], lambda x: {_IS_TEST})) > 0 or len(list_filter([regexp_replace(parts[-1], '\\.[^.]*$', '')], lambda x: {_IS_TEST})) > 0 as is_test,
  len(list_filter(parts[:-2], lambda x: x in {paths.EXCLUDED_DIRS} or regexp_matches(x, '(-musl-cross|-gcc-cross|-elf-cross)$') or regexp_matches(x, 'busybox|ltp-full|ltp_full') or {_IS_TEST})) > 0 as is_excluded, contains('/' || p || '/', '/example/com/') as in_com from q""",
    "line_search": r"""with l as (select doc_id, source || '/' || lang as path, unnest(string_split(coalesce(text, ''), chr(10))) as t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as line from documents)
select doc_id, line::int as line, md5(t) as content_md5 from l where path glob 'src1?/*n' and regexp_matches(t, '[0-9]{2}[^ ]* [A-Za-z]')""",
    "symbol_references": f"""with {_CALLS}, g as (select callee, split_part(file, '/', 1) as subsystem, caller, file from c where regexp_matches(callee, '^pu_[0-9]$'))
select callee as symbol, subsystem, count(*) as n, count(distinct caller) as callers, count(distinct file) as files from g group by 1, 2""",
    "subtree_edges": f"""with {_CALLS}, d as (select distinct caller as name from c where starts_with(file, 'click/')), k as (select case when starts_with(file, 'click/') and callee in (select name from d) then 'internal' when starts_with(file, 'click/') then 'outgoing' when callee in (select name from d) then 'incoming' end as kind, caller, callee from c)
select kind, count(*) as n, count(distinct caller) as callers, count(distinct callee) as callees from k where kind is not null group by 1""",
    "evidence_rules": """with c as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events),
cand as (select user_id, event_id, value > 400 as must from c where value > 300), rev as (select user_id, event_id from c where value > 300 and event_id % 11 <> 0 union all select user_id, event_id from c where value > 300 and event_id % 13 = 0),
n as (select user_id, event_id, must, count(rev.event_id) as n from cand left join rev using (user_id, event_id) group by all),
st as (select user_id, (seq / 25)::int as stage0, seq // 25 as stage, seq as start, seq + 30 as key from c where seq % 25 = user_id % 2), lst as (select user_id, max(seq) as last from c group by 1),
o as (select *, lag(start) over (partition by user_id order by stage) as before, lead(start) over (partition by user_id order by stage) as nxt from st join lst using (user_id)),
v as (select user_id, 'not_reviewed' as rule from n where n = 0 union all select user_id, 'reviewed_again' from n where n > 1 union all select user_id, 'must_be_told' from n where must and n = 0
  union all select user_id, 'first_stage' from o where before is null and start <> 0 union all select user_id, 'stage_order' from o where before is not null and start <= before
  union all select user_id, 'key_outside' from o where key < start or key > coalesce(nxt - 1, last))
select user_id, rule, count(*) as n from v group by 1, 2""",
}
