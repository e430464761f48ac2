"""Registered queries of tags, repository facts and finished reports, with their DuckDB SQL. Sources and reports in JSON are
made by Spark from supplier, nation and events, as the driver's tables hold none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from kinfolk.functions import labels
from kinfolk.functions import text as X
from kinfolk.operators import citations, repo_facts, tagging
from kinfolk.plans.queries import table
from kinfolk.runtime import stored

RULES = [("path", "src3/en"), ("path", "/src4/"), ("name", "^th"), ("name", "en$"), ("context", "src5/"), ("adapter", "^[aeiou]")]
PAGE_RULES = [("&amp;&amp;&amp;", "&amp;"), ("/<(script|style)[^>]*>.*?</(?:script|style)>/", ""), ("***", ""), (r"/(\w)%%%/", "$1"), ("<nav>", "<div>"), ("</nav>", "</div>")]


def abi_bases(spark, sf_dir):
    """Why documents taken for functions are as they are: source and lang for the path, the first word for the name."""
    path = F.concat_ws("/", "source", "lang", F.lit("x"))
    name = F.lower(F.get(X.words(F.col("text")), F.lit(0)))
    basis = tagging.abi_basis(path, name, F.col("text"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", basis.alias("basis"), tagging.standard_constants(F.col("text")).alias("constants"))


def rewritten_labels(spark, sf_dir):
    """Pages after an ordered table of rules, whether the rules have settled, and what is left of what they replace."""
    once = labels.rewritten(F.coalesce("html", F.lit("")), PAGE_RULES)
    rows = table(spark, sf_dir, "pages").select("page_id", once.alias("once"))
    settled = labels.rewritten(F.col("once"), PAGE_RULES) == F.col("once")
    return rows.select("page_id", F.md5(F.col("once").cast("binary")).alias("text_md5"), settled.alias("settled"), F.array_join(labels.residual(F.col("once"), ("&amp;&amp;", "%%%", "###")), ",").alias("left_over"))


def sources_of(spark, sf_dir):
    """A repository per nation with a C source per supplier: a system call named for it and a dispatch with two arms, one
    of them in a comment."""
    k = F.col("s_suppkey")
    call = F.get(F.array(*map(F.lit, [*repo_facts.STANDARD, "extra"])), F.pmod(k, F.lit(len(repo_facts.STANDARD) + 1)).cast("int"))
    arm = lambda n: F.concat(F.lit("SYS_"), F.upper(F.substring("s_name", 1, 3)), F.pmod(k * n, F.lit(17)).cast("string"))
    text = F.concat(F.lit("// int sys_gone(int a)\nint sys_"), call, F.lit("(int a)\n{\n  int b["), F.lit("2];\n  switch (a) {\n  case "), arm(3), F.lit(": return 1;\n  /* case "), arm(5), F.lit(": */\n  }\n  "), arm(7), F.lit(";\n}\n"))
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"), F.concat(F.when(k % 10 == 0, "vendor/s").otherwise("kernel/s"), k.cast("string"), F.lit(".c")).alias("path"), text.alias("text"))


def repository_facts(spark, sf_dir):
    found = repo_facts.scanned(sources_of(spark, sf_dir))
    calls = repo_facts.implemented_calls(found).groupBy("repo").agg(F.count("*").alias("n_calls"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("calls"))
    arms = repo_facts.dispatch_arms(found).select("repo", "arms", F.array_join("places", ",").alias("places"))
    return arms.join(calls, "repo", "left")


def error_markers(spark, sf_dir):
    """A report per user: its days, their events, an error in some; where the errors are."""
    day = F.date_format("ts", "yyyy-MM-dd")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("lost "), F.col("event_id").cast("string")))
    days = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", error.alias("_error")))).alias("events"))
    users = days.groupBy("user_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("day", "events"))).alias("days"))).alias("json"))
    return citations.error_markers(stored(users, "reports"), "user_id", "json")


QUERIES: dict[str, Callable] = {f.__name__: f for f in (abi_bases, rewritten_labels, repository_facts, error_markers)}

_MAGIC = " or ".join(f"contains(lower(text), '{m}')" for m in tagging.MAGIC)
_STANDARD = ", ".join(f"'{x}'" for x in [*repo_facts.STANDARD, "extra"])

ORACLE: dict[str, str] = {
    "abi_bases": rf"""with d as (select doc_id, coalesce(text, '') as text, source || '/' || lang || '/x' as path, coalesce(lower((regexp_extract_all(text, '[^\x20\x09-\x0D]+'))[1]), '') as name,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as ls from documents),
e as (select *, len(ls) as n, lower(array_to_string(ls, chr(10))) as low,
  list_distinct(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_])([0-9]{{1,2}})(?:$|[^0-9A-Za-z_])', 1)) as nums0,
  list_distinct(list_filter(regexp_split_to_array(text, '[^0-9A-Za-z_]+'), lambda x: regexp_full_match(x, '[0-9]{{1,2}}'))) as nums,
  len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^(sig|timer|alarm|itimer)'))) > 0 as about from d),
f as (select *, about and (list_has_all(nums, {list(tagging.TIMERS)}) or len(list_intersect(nums, {list(tagging.SIGNALS)})) >= 4) as sig, {_MAGIC} as magic, strpos(low, '{{') as o, length(low) - strpos(reverse(low), '}}') + 1 as c, strpos(low, '}}') as c0 from e),
g as (select *, case when o > 0 and c0 > 0 and o < c then substr(low, o + 1, c - o - 1) else '' end as body from f),
h as (select *, (sig or magic) as constants,
  n > 0 and n <= 45 and not regexp_matches(low, '\b(for|while|loop)\b') and case when sig then regexp_matches(low, '\b(match|switch)\b') or n <= 20 else n <= 8 or (n <= 35 and len(regexp_extract_all(text, '(?m)^\s*[A-Za-z_]\w*\s*:\s*')) >= 5) end as short_,
  n > 0 and n <= 32 and not regexp_matches(low, '\b(for|while|loop|match|switch|case|await|yield)\b') and len(regexp_extract_all(low, '\bif\b')) <= 1 and length(body) - length(replace(body, ';', '')) <= 4
    and (len(list_filter(regexp_extract_all(body, '\b([a-z_]\w*)\s*\(', 1), lambda x: x not in ('if', 'while', 'for', 'match'))) > 0 or regexp_matches(body, '\bas\s+[a-z_]') or regexp_matches(body, '\b(into|from|try_from)\s*\(') or regexp_matches(body, '(=|return|=>|\()\s*[a-z_]\w*\s*\{{')) as thin from g)
select doc_id, constants, case when contains('/' || path || '/', '/src3/en/') or contains('/' || path || '/', '/src4/') then 'non_product_or_compatibility_path' when regexp_matches(name, '^th') or regexp_matches(name, 'en$') then 'explicit_abi_conversion'
  when constants and short_ then 'standard_mapping_dominates' when (contains('/' || path || '/', '/src5/') or regexp_matches(name, '^[aeiou]')) and thin then 'thin_abi_adapter' end as basis from h""",
    "rewritten_labels": r"""with r(k, t) as (select page_id, coalesce(html, '') from pages),
s as (select k, replace(replace(regexp_replace(replace(regexp_replace(replace(t, '&amp;&amp;&amp;', '&amp;'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '***', ''), '([0-9A-Za-z_])%%%', '\1', 'g'), '<nav>', '<div>'), '</nav>', '</div>') as t from r),
u as (select k, t, replace(replace(regexp_replace(replace(regexp_replace(replace(t, '&amp;&amp;&amp;', '&amp;'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '***', ''), '([0-9A-Za-z_])%%%', '\1', 'g'), '<nav>', '<div>'), '</nav>', '</div>') as t2 from s)
select k as page_id, md5(t) as text_md5, t = t2 as settled, array_to_string(list_filter(['&amp;&amp;', '%%%', '###'], lambda x: contains(t, x)), ',') as left_over from u""",
    "repository_facts": f"""with s as (select n_name as repo, s_suppkey as k, upper(substr(s_name, 1, 3)) as p, [{_STANDARD}][(s_suppkey % {len(repo_facts.STANDARD) + 1})::int + 1] as call from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 10 <> 0),
a as (select repo, count(distinct p || (k * 3 % 17)) as arms from s group by 1),
f as (select repo, string_agg('kernel/s' || k || '.c:6', ',' order by 'kernel/s' || k || '.c') as places from (select *, row_number() over (partition by repo order by 'kernel/s' || k || '.c') as r from s) where r <= 6 group by 1),
c as (select repo, count(distinct call) as n_calls, array_to_string(list_sort(list_distinct(list(call))), ',') as calls from s where call <> 'extra' group by 1)
select repo, arms, places, n_calls, calls from a join f using (repo) left join c using (repo)""",
    "error_markers": """with e as (select user_id, event_id, event_type, strftime(ts, '%Y-%m-%d') as day from events),
p as (select *, dense_rank() over (partition by user_id order by day) - 1 as i, row_number() over (partition by user_id, day order by event_id) - 1 as j from e)
select user_id, 'report.days[' || i || '].events[' || j || ']' as path, 'lost ' || event_id as message from p where event_type = 'error'""",
}
