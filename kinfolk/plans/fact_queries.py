"""Registered queries of catalogs of facts, provenance by path, small functions over texts and orders of findings, with their
DuckDB SQL. Hosts of pages, cut at their dots, stand for folders; sources of documents for repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions import code as C
from kinfolk.functions import text as X
from kinfolk.operators import catalog, features, history, review, selection, vectors, verdicts
from kinfolk.plans.oracle import COS, LINE_ARRAY, LINKS, LOWER_WORDS, TOPK, WORDS
from kinfolk.plans.queries import asked, pairs_of, table
from kinfolk.plans.verdict_queries import _CALLS, calls_of

SEVERITIES = ["error", "purchase", "view"]
SIGNS = [features.Sign("north", "source", "und"), features.Sign("south", "source", "que"), features.Sign("west", "function", "thing"), features.Sign("south", "function", "los"), features.Sign("north", "commit", "der")]
STANDARD = ("the", "and", "der", "und", "que", "los", "lorem", "ipsum")


def page_paths(spark, sf_dir) -> DataFrame:
    bare = F.replace(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.lit("."), F.lit("/"))
    return table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), "page_id", F.lower(bare).alias("path"))


def library_contexts(spark, sf_dir):
    """The library of each page's path: of the longest root on it."""
    roots = spark.createDataFrame([("r", "blog", "blogs"), ("r", "Blog/tiontion/", "tiontion"), ("r", "m", "mobile"), ("q", "therha", "other")], "repo string, root string, library string")
    return catalog.library_context(page_paths(spark, sf_dir), roots).select("page_id", "library")


def framework_paths(spark, sf_dir):
    layout = spark.createDataFrame([("example", "com", x) for x in ("en", "fr")], "root string, container string, child string")
    return catalog.layout_paths(page_paths(spark, sf_dir), layout)


def same_trees(spark, sf_dir):
    """Pages (by hundreds) whose path below 'example' is that of the page of that number's first."""
    rows = page_paths(spark, sf_dir)
    firsts = rows.filter("page_id % 100 = 0").select(F.col("page_id").alias("first"), F.col("path").alias("q"))
    met = rows.withColumn("first", F.col("page_id") - F.col("page_id") % 100).join(firsts, "first")
    return met.select("page_id", catalog.same_tree(F.regexp_replace("q", r"\d+.*$", ""), F.regexp_replace("path", r"\d+.*$", ""), F.lit("example")).alias("same"))


def page_subsystems(spark, sf_dir):
    rows = page_paths(spark, sf_dir).select("path").distinct()
    own = rows.filter(F.col("path").rlike("99")).select("path", F.lit("nineties").alias("subsystem"))
    words = spark.createDataFrame([("en", "english"), ("fr", "french"), ("com", "commerce"), ("blog", "blogs")], "word string, subsystem string")
    return catalog.file_subsystem(rows, own, words)


def standard_words(spark, sf_dir):
    """A standard list of words against those of documents; a word counts as implemented if a long document has it."""
    standard = spark.createDataFrame([(w, w[0]) for w in STANDARD], "name string, category string")
    rows = table(spark, sf_dir, "documents").select(X.words(F.lower("text")).alias("w"))
    rows = rows.select(F.array_distinct("w").alias("w"), (F.size("w") >= 3000).alias("implemented"))  # before the words are rows
    found = rows.select(F.explode("w").alias("name"), "implemented")
    return catalog.standard_coverage(standard, found).filter("state <> 'extra'")


def symbol_callers(spark, sf_dir):
    """Which functions call pu_1, pu_2 or er_3, and from which file."""
    rows = calls_of(spark, sf_dir).groupBy("file", F.col("caller").alias("name")).agg(F.collect_set("callee").alias("calls"))
    return catalog.callers(rows, spark.createDataFrame([("pu_1",), ("pu_2",), ("er_3",)], "symbol string"))


def source_languages(spark, sf_dir):
    return review.languages(table(spark, sf_dir, "documents").withColumnRenamed("source", "repo"))


def source_kinds(spark, sf_dir):
    return review.kernel_type(table(spark, sf_dir, "documents").withColumnRenamed("source", "repo"), ["zen", "ungs", "keit"], ["the th", "que de", "$$$"])


def document_subsystems(spark, sf_dir):
    keywords = spark.createDataFrame([("a", "the"), ("a", "and"), ("a", "of"), ("b", "und"), ("b", "der"), ("c", "que"), ("c", "les"), ("c", "and")], "subsystem string, keyword string")
    return review.subsystems(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "path"), keywords)


def tied_sources(spark, sf_dir):
    """Per language the sources with the most documents, and whether they tie."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return review.disambiguate(rows, "lang", "n")


def reference_signs(spark, sf_dir):
    """Which of three references each source's documents speak for."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    first = files.filter("cast(path as long) % 97 = 3").select("repo", F.substring("text", 1, 60).alias("subject"))
    return features.reference_scores(files, first, SIGNS).select("repo", "reference", "confidence", "score")


def text_facts(spark, sf_dir):
    """Naming style, windows, line chunks and anchors of documents."""
    t = F.coalesce("text", F.lit(""))
    w = X.words(t)
    n = F.size(F.split(t, "\n"))
    chunks, windows = C.merge_short(C.line_chunks(n, 4), 3), C.token_windows(w, 64, 48)
    anchor = F.when(F.col("doc_id") % 2 == 0, "the").otherwise(", t")
    return table(spark, sf_dir, "documents").select("doc_id", X.naming_style(F.regexp_replace(t, r"[^\x00-\x7F]", " ")).alias("style"), F.size(chunks).alias("n_chunks"), F.try_element_at(chunks, F.lit(-1))["start"].alias("last_chunk"), F.size(windows).alias("n_windows"), F.size(F.try_element_at(windows, F.lit(-1))).alias("last_window"), C.holds_anchor(t, anchor).alias("anchored"), C.last_status(t, r"\band\b", r"\bthe\b").alias("status"))


def event_properties(spark, sf_dir):
    """Properties of events as JSON objects, with the number they hold; every seventh is broken first."""
    text = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 7 == 1, F.lit("[1, 2]")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.json_object(text).isNotNull().alias("is_object"), X.json_number(F.when(X.json_object(text).isNotNull(), text), "$.k", -1.0).alias("k"), F.size(X.json_list(text)).alias("n_items"))


def nearest_sources(spark, sf_dir):
    """The labels that the nearest vectors of all queries have, the most frequent five."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("grp"), F.col("embedding").alias("v"), "label")
    near = vectors.topk(rows.filter(asked("id")), rows, 20)
    return vectors.top_groups(near.join(rows.select("id", F.col("label").cast("string").alias("source")), "id"), "source", 0.25, 5)


def ordered_findings(spark, sf_dir):
    """Errors before purchases before views, large ones of few users first: the first forty events."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("severity"), F.col("value").alias("confidence"), "user_id")
    return verdicts.by_priority(rows, SEVERITIES, [(F.col("user_id") % 5 == 1, 2), (F.col("user_id") % 5 < 3, 0)], 1).select("id", "severity").limit(40)


def merged_findings(spark, sf_dir):
    severity = F.when(F.col("value") > 400, "critical").when(F.col("value") > 200, "high").otherwise("low")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("source"), F.col("event_type").alias("title"), severity.alias("severity"), F.col("value").alias("confidence"), F.col("event_id").cast("string").alias("detail"))
    return selection.merge_findings(rows, 20).select("source", "title", "n", "severity_rank", F.round("confidence", 4).alias("confidence"), "detail")


def balanced_pool(spark, sf_dir):
    """At most three pairs of a language, ten in all, the most alike first."""
    rows = pairs_of(spark, sf_dir)
    return selection.balanced(rows, "module", [F.desc("line_sim"), F.col("q_id"), F.col("c_id")], 3, 10).select("q_id", "c_id", "module")


def most_similar_pairs(spark, sf_dir):
    out = verdicts.most_similar(pairs_of(spark, sf_dir), F.col("line_sim") > 2, F.col("tier") == "confirmed")
    return out.select("q_id", "c_id")


def stage_files(spark, sf_dir):
    """What each kind of event brought to the stages of the large users, the most first."""
    commits = table(spark, sf_dir, "events").filter("user_id % 10 = 0").select(F.col("user_id").alias("grp"), (F.row_number().over(history.W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"), F.array(F.struct(F.col("event_type").alias("path"), F.floor("value").cast("long").alias("additions"), F.lit(1).cast("long").alias("deletions"))).alias("files"))
    ranges = spark.range(4).select(F.col("id").cast("int").alias("stage"), (F.col("id") * 20).alias("start"), (F.col("id") * 20 + 19).alias("stop"))
    groups = commits.select("grp").distinct()
    return history.stage_files(commits, groups.select("grp", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("stage")).join(ranges, "stage"), "grp")


QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        library_contexts, framework_paths, same_trees, page_subsystems, standard_words, symbol_callers, source_languages, source_kinds,
        document_subsystems, tied_sources, reference_signs, text_facts, event_properties, nearest_sources, ordered_findings,
        merged_findings, balanced_pool, most_similar_pairs, stage_files,
    )
}

_P = "p as (select page_id, lower(replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '.', '/')) as path from pages), q as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p)"
_TAIL = "case when list_position({p}, 'example') > 0 then array_to_string({p}[list_position({p}, 'example') + 1:], '/') end"

ORACLE: dict[str, str] = {
    "library_contexts": f"with {_P} select page_id, case when parts[1] = 'blog' and parts[2] = 'tiontion' then 'tiontion' when parts[1] = 'blog' then 'blogs' when parts[1] = 'm' then 'mobile' end as library from q",
    "framework_paths": f"with {_P} select distinct path from q where contains('/' || array_to_string(parts, '/') || '/', '/example/com/en/') or contains('/' || array_to_string(parts, '/') || '/', '/example/com/fr/')",
    "same_trees": f"""with {_P}, c as (select page_id, page_id - page_id % 100 as first, list_filter(string_split(regexp_replace(path, '[0-9]+.*$', ''), '/'), lambda x: x <> '') as cp from q),
m as (select a.page_id, a.cp, b.cp as qp from c a join c b on b.page_id = a.first), r as (select *, {_TAIL.format(p='qp')} as a, {_TAIL.format(p='cp')} as b from m)
select page_id, coalesce(a = b, false) or coalesce(a <> '' and ends_with('/' || array_to_string(cp, '/'), '/' || a), false) or coalesce(b <> '' and ends_with('/' || array_to_string(qp, '/'), '/' || b), false) as same from r""",
    "page_subsystems": f"""with {_P}, d as (select distinct path from p), w as (select path, regexp_split_to_array(path, '[/._-]+') as ws from d)
select path, case when contains(path, '99') then 'nineties' else coalesce(list_filter(list_transform(ws, lambda x: case x when 'en' then 'english' when 'fr' then 'french' when 'com' then 'commerce' when 'blog' then 'blogs' end), lambda x: x is not null)[1], 'other') end as subsystem from w""",
    "standard_words": f"""with s as (select unnest({list(STANDARD)}) as name), w as (select {LOWER_WORDS} as w from documents), f as (select name, bool_or(long) as ok from (select unnest(list_distinct(w)) as name, len(w) >= 3000 as long from w) group by 1)
select s.name, s.name[1] as category, case when ok is null then 'missing' when ok then 'covered' else 'constant_only' end as state from s left join f using (name)""",
    "symbol_callers": f"with {_CALLS} select distinct callee as symbol, file, caller from c where callee in ('pu_1', 'pu_2', 'er_3')",
    "source_languages": """with l as (select source as repo, lang, sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')))::bigint as loc from documents group by 1, 2)
select repo, lang, loc, row_number() over (partition by repo order by loc desc, lang)::int as rank from l""",
    "source_kinds": """with v as (select source as repo, sum(contains(text, 'zen')::int + contains(text, 'ungs')::int + contains(text, 'keit')::int) as a, sum(contains(text, 'the th')::int + contains(text, 'que de')::int + contains(text, '$$$')::int) as b from documents group by 1)
select repo, case when a >= 3 then 'microkernel' when b >= 2 or a = 0 then 'monolithic' else 'unknown' end as kind from v""",
    "document_subsystems": """with k as (select * from (values ('a', ['the', 'and', 'of']), ('b', ['und', 'der']), ('c', ['que', 'les', 'and'])) v(subsystem, ks)),
h as (select doc_id as path, subsystem, len(list_filter(ks, lambda x: contains(lower(coalesce(text, '')), x)))::int as hits from documents, k)
select path, subsystem, hits, hits = max(hits) over (partition by path) as is_primary from h where hits >= 2""",
    "tied_sources": "with n as (select lang, source, count(*) as n from documents group by 1, 2), r as (select *, rank() over (partition by lang order by n desc) as r from n) select lang, source, n, count(*) over (partition by lang) > 1 as tied from r where r = 1",
    "reference_signs": """with s as (select source as repo, (sum(contains(text, 'und')::int) * 3)::int as und, (sum(contains(text, 'que')::int) * 3)::int as que, bool_or(contains(text, 'thing'))::int as thing, bool_or(contains(text, 'los'))::int as los,
  5 * coalesce(bool_or(contains(lower(substr(text, 1, 60)), 'der')) filter (doc_id % 97 = 3), false)::int as der from documents group by 1),
t as (select repo, und + der as north, que + los as south, thing as west from s), g as (select *, greatest(north, south, west) as best from t)
select repo, case when best = 0 then null when north = best then 'north' when south = best then 'south' else 'west' end as reference, case when best = 0 or best >= 8 then 'high' when best >= 4 then 'medium' else 'low' end as confidence, best::int as score from g""",
    "text_facts": rf"""with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g') as ta, {WORDS} as w, len(string_split(coalesce(text, ''), chr(10))) as n from documents),
s as (select *, len(regexp_extract_all(ta, '\b(?:fn|void|int)\s+[a-z][a-z0-9_]+\s*\(')) as snake, len(regexp_extract_all(ta, '\b[A-Z][A-Za-z0-9]{{3,}}\b')) as camel, ((n + 3) // 4)::int as c, n - ((n + 3) // 4 - 1) * 4 as rest, len(w) as k from d)
select doc_id, case when camel > 2 * snake then 'CamelCase' when snake > 2 * camel then 'snake_case' else 'mixed' end as style, case when c > 1 and rest < 3 then c - 1 else c end::int as n_chunks, (case when c > 1 and rest < 3 then c - 2 else c - 1 end * 4 + 1)::int as last_chunk,
  (1 + greatest(ceil((k - 64) / 48.0), 0))::int as n_windows, (k - 48 * greatest(ceil((k - 64) / 48.0), 0))::int as last_window,
  case when doc_id % 2 = 0 then list_contains(regexp_split_to_array(t, '[^A-Za-z0-9_]+'), 'the') else contains(t, ', t') or contains(trim(regexp_replace(t, '\s+', ' ', 'g')), ', t') or contains(regexp_replace(t, '\s+', '', 'g'), ',t') end as anchored,
  case when not regexp_matches(t, '\band\b') and not regexp_matches(t, '\bthe\b') then 'unknown' when not regexp_matches(t, '\bthe\b') then 'failed' when not regexp_matches(t, '\band\b') then 'passed'
    when length(regexp_split_to_array(t, '\band\b')[-1]) < length(regexp_split_to_array(t, '\bthe\b')[-1]) then 'failed' else 'passed' end as status from s""",
    "event_properties": """select event_id, event_id % 7 not in (0, 1) as is_object, case when event_id % 7 not in (0, 1) then (props->>'$.k')::double else -1 end as k, case when event_id % 7 = 1 then 2 else 0 end::int as n_items from events""",
    "nearest_sources": f"""with t as ({TOPK.format(cos=COS, on='true', k=20)}) select label::varchar as source, count(*) as n, round(max(score), 5) as best from t join embeddings e on e.vec_id = t.id where score >= 0.25 group by 1 order by n desc, source limit 5""",
    "ordered_findings": """select event_id as id, event_type as severity from events order by case event_type when 'error' then 1 when 'purchase' then 2 when 'view' then 3 else 4 end, case when user_id % 5 = 1 then 2 when user_id % 5 < 3 then 0 else 1 end, value desc, event_id limit 40""",
    "merged_findings": """with r as (select user_id % 7 as source, event_type as title, case when value > 400 then 0 when value > 200 then 1 else 3 end as rank, value, event_id::varchar as detail from events),
m as (select source, title, count(*) as n, (list({'r': rank, 'v': -value, 'd': detail} order by rank, -value, detail))[1] as b from r group by 1, 2),
t as (select source, title, n, b.r as severity_rank, -b.v as confidence, b.d as detail, row_number() over (partition by source order by b.r, b.v, title) as turn from m)
select source, title, n, severity_rank::int as severity_rank, round(confidence, 4) as confidence, detail from t order by case when turn > 1 then 1 else 0 end, severity_rank, confidence desc, title, source limit 20""",
    "balanced_pool": f"""with {LINKS}, r as (select *, row_number() over (partition by module order by line_sim desc, q_id, c_id) as m from pairs) select q_id, c_id, module from r where m <= 3 order by line_sim desc, q_id, c_id limit 10""",
    "most_similar_pairs": f"with {LINKS} select q_id, c_id from pairs where tier = 'confirmed'",
    "stage_files": """with c as (select user_id as grp, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_type as path, floor(value)::bigint as a from events where user_id % 10 = 0),
s as (select grp, (seq // 20)::int as stage, path, sum(a)::bigint as additions, count(*) as deletions, count(*) as commits from c where seq < 80 group by 1, 2, 3)
select grp, stage, path, additions, deletions, commits, row_number() over (partition by grp, stage order by additions + deletions desc, path)::int as rank from s""",
}
