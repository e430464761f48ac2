"""Registered queries of catalogs, citations and provenance, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions import text as X
from kinfolk.operators import catalog, citations, comparison, verdicts
from kinfolk.plans.oracle import LINE_ARRAY, LINKS, LOWER_WORDS
from kinfolk.plans.queries import asked, first_line, pairs_of, table

TIERS = ["confirmed", "review", "weak"]
KINDS = ["1-URGENT", "5-LOW", "3-MEDIUM"]
EVENTS = ["purchase", "error"]


def commit_citations(spark, sf_dir):
    """Events as commits (their hash is the id's md5), cited by prefixes of 7 to 16 digits and by some that run on wrongly."""
    ids = table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    short = ids.filter(asked("event_id")).select(F.expr("substr(sha, 1, cast(7 + event_id % 10 as int))").alias("cited"))
    wrong = ids.filter("event_id % 100 = 0").select(F.concat(F.substring("sha", 1, 12), F.lit("ffff")).alias("cited"))
    return citations.resolved_commits(short.union(wrong), ids.select("sha"))


def commit_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.col("event_type").alias("author"), F.col("event_id").cast("string").alias("subject"))
    out = catalog.commit_summary(rows, "user_id", 3, 5)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("user_id", "n", day("since"), day("until"), F.array_join("authors", ",").alias("authors"), F.array_join("subjects", ",").alias("subjects"))


def orders_by_year(spark, sf_dir):
    return catalog.by_year(table(spark, sf_dir, "orders"), F.col("o_orderdate"))


def recent_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), "o_orderdate")
    return catalog.by_kind(rows, KINDS, "o_orderdate", 100).select("id", "kind")


def catalog_page(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return catalog.page(rows, [F.desc("c_mktsegment"), F.col("c_name"), F.col("c_custkey")], 20, 3)


def exclusive_source_tiers(spark, sf_dir):
    rows = pairs_of(spark, sf_dir).select("c_source", "q_id", F.col("tier").alias("cls"))
    return verdicts.exclusive_counts(rows, "c_source", TIERS)


def targeted_recall(spark, sf_dir):
    """In three sources chosen for each language, documents whose first line shares words with an asked one's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", first_line().alias("name"), F.size(X.line_array(F.col("text"))).alias("n_lines"))
    rows = docs.withColumn("module", F.col("lang"))
    chosen = rows.select("module").distinct().select("module", F.explode(F.array(*(F.struct(F.lit(f"src{k}").alias("source"), F.lit(k).alias("place")) for k in range(3)))).alias("x")).select("module", "x.*")
    return catalog.targeted_recall(rows.filter(asked()).withColumnRenamed("doc_id", "q_id"), rows.withColumnRenamed("doc_id", "c_id"), chosen)


def vocabulary_states(spark, sf_dir):
    """Words of the benchmark against those of all documents: in both, new, or in documents only."""
    names = lambda t: table(spark, sf_dir, t).select(F.explode(X.words(F.lower("text"))).alias("name"))
    return comparison.name_states(names("benchmark"), names("documents"), comparison.TRIVIAL)


def first_strategies(spark, sf_dir):
    """The strongest kind of event of each user."""
    hits = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("strategy"), "event_id")
    return comparison.first_strategy(hits, "user_id", EVENTS, "event_id")


def top_items(spark, sf_dir):
    """The four dearest items of each order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return comparison.top_within(rows, "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], 4).drop("l_extendedprice")


def identifier_terms(spark, sf_dir):
    terms = F.sort_array(X.identifier_terms(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", terms.alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms_md5"))


QUERIES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (commit_citations, commit_summary, orders_by_year, recent_jobs, catalog_page, exclusive_source_tiers, targeted_recall, vocabulary_states, first_strategies, top_items, identifier_terms)
}

_PARTS = r"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))"

ORACLE: dict[str, str] = {
    "commit_citations": """with c as (select md5(event_id::varchar) as sha, event_id from events),
q as (select distinct substr(sha, 1, (7 + event_id % 10)::int) as cited from c where event_id % 50 = 0 union select substr(sha, 1, 12) || 'ffff' from c where event_id % 100 = 0),
a as (select cited, count(sha) as n, min(sha) as s from q left join c on starts_with(sha, cited) group by 1), b as (select cited, count(sha) as n, min(sha) as s from q left join c on length(cited) > 12 and starts_with(sha, substr(cited, 1, 12)) group by 1)
select cited, case when a.n > 0 then a.n else b.n end as n, case when (case when a.n > 0 then a.n else b.n end) = 1 then coalesce(a.s, b.s) end as sha from a join b using (cited)""",
    "commit_summary": """with a as (select user_id, event_type, count(*) as k, row_number() over (partition by user_id order by count(*) desc, event_type) as r from events group by 1, 2),
s as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
select user_id, n, since, until, authors, subjects from (select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d') as since, strftime(max(ts), '%Y-%m-%d') as until from events group by 1)
join (select user_id, string_agg(event_type || ':' || k, ',' order by r) as authors from a where r <= 3 group by 1) using (user_id) join (select user_id, string_agg(event_id::varchar, ',' order by r) as subjects from s where r <= 5 group by 1) using (user_id)""",
    "orders_by_year": "select year(o_orderdate)::int as year, count(*) as n from orders group by 1",
    "recent_jobs": "select o_orderkey as id, o_orderpriority as kind from orders order by case o_orderpriority when '1-URGENT' then 1 when '5-LOW' then 2 when '3-MEDIUM' then 3 else 4 end, o_orderdate desc, o_orderkey limit 100",
    "catalog_page": "select c_custkey, c_name, c_mktsegment from customer order by c_mktsegment desc, c_name, c_custkey limit 20 offset 60",
    "exclusive_source_tiers": f"""with {LINKS}, f as (select c_source, q_id, bool_or(tier = 'confirmed') as a, bool_or(tier = 'review') as b, bool_or(tier = 'weak') as c from pairs group by 1, 2)
select c_source, count(*) filter (a) as confirmed, count(*) filter (b and not a) as review, count(*) filter (c and not a and not b) as weak from f group by 1""",
    "targeted_recall": rf"""with n as (select doc_id, source, lang, coalesce(({LINE_ARRAY})[1], '') as name, len({LINE_ARRAY}) as lines from documents), p as (select *, {_PARTS} as parts from n),
m as (select q.doc_id as q_id, c.doc_id as c_id, c.source, q.name = c.name as same, len(list_intersect(q.parts, c.parts)) / len(list_distinct(list_concat(q.parts, c.parts)))::double as near, least(q.lines, c.lines) / greatest(q.lines, c.lines)::double as size
  from p q join p c on q.lang = c.lang and list_has_any(q.parts, c.parts) where q.doc_id % 50 = 0 and c.source in ('src0', 'src1', 'src2')),
r as (select *, row_number() over (partition by q_id, source order by same desc, near desc, size desc, c_id) as rank from m where same or near >= 0.25)
select q_id, c_id, source, substr(source, 4)::int as place, rank::int as rank from r where rank <= 80""",
    "vocabulary_states": f"""with c as (select distinct unnest({LOWER_WORDS}) as name from benchmark), r as (select distinct unnest({LOWER_WORDS}) as name from documents)
select coalesce(c.name, r.name) as name, case when r.name is null then 'new' when c.name is null then 'reference_only' else 'both' end as state from c full join r on c.name = r.name
where r.name is not null or c.name not in {comparison.TRIVIAL}""",
    "first_strategies": """select user_id, event_type as strategy, event_id from (select *, row_number() over (partition by user_id order by case event_type when 'purchase' then 1 when 'error' then 2 else 3 end, event_type, event_id) as r from events) where r = 1""",
    "top_items": "select l_orderkey, l_linenumber, rank::int as rank from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank from lineitem) where rank <= 4",
    "identifier_terms": r"""with n as (select doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[a-z][a-z0-9_]*') as n from documents),
t as (select doc_id, list_sort(list_distinct(list_concat(n, list_filter(string_split(array_to_string(n, '_'), '_'), lambda x: x <> '')))) as t from n)
select doc_id, len(t)::int as n_terms, md5(array_to_string(t, ' ')) as terms_md5 from t""",
}
