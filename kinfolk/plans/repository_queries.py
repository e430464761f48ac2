"""Registered queries of repositories' files, with their DuckDB SQL. The driver's tables hold no makefiles and no HTML tables,
so the first two read files and pages that Spark makes of region, nation and supplier, or of customer and orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.operators import code_rows, libraries, makefiles
from kinfolk.plans.queries import table
from kinfolk.runtime import stored
from kinfolk.sources import html_tables


def makefiles_of(spark, sf_dir) -> DataFrame:
    """A repository per region: its Makefile includes a file per nation, which includes the file of each of its suppliers
    (and the Makefile again)."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repo"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("repo", "n_nationkey", F.col("s_suppkey").alias("k"))
    lines = lambda key, make: F.array_join(F.transform(F.array_sort(F.collect_list(key)), make), "\n")
    root = nations.groupBy("repo").agg(F.concat(F.lit("NAME := kernel\nPARTS = \\\n  nations\nall: build # all\n\t@true\ninclude "), F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: F.concat(F.lit("${PARTS}/n"), x.cast("string"), F.lit(".mk"))), " "), F.lit("\n")).alias("text"))
    mids = suppliers.groupBy("repo", "n_nationkey").agg(lines("k", lambda x: F.concat(F.lit("-include ../s/"), x.cast("string"), F.lit(".mk"))).alias("text"))
    mids = mids.select("repo", F.concat(F.lit("nations/n"), F.col("n_nationkey").cast("string"), F.lit(".mk")).alias("path"), F.concat(F.lit("include ../Makefile\n"), "text").alias("text"))
    k = F.col("k").cast("string")
    said = F.when(F.col("k") % 5 == 0, F.concat(F.lit("# rule\n$(NAME)-rv:\n\t@echo "), k)).when(F.col("k") % 3 == 0, F.concat(F.lit("build_"), k, F.lit(":\n\tcp out/"), k, F.lit(".bin $(NAME)-la"))).otherwise(F.lit("NAME2 := $(NAME)"))
    leaves = suppliers.select("repo", F.concat(F.lit("s/"), k, F.lit(".mk")).alias("path"), said.alias("text"))
    return root.select("repo", F.lit("Makefile").alias("path"), "text").unionByName(mids).unionByName(leaves)


def make_outputs(spark, sf_dir):
    return makefiles.declared_outputs(stored(makefiles_of(spark, sf_dir), "makefiles"))


def tables_of(spark, sf_dir) -> DataFrame:
    """A page per customer: a table of its own name, inside whose cell stands the table of its orders, in which equal
    neighbours of a status share a cell."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "o_orderkey", "o_orderpriority"))).alias("o"))

    def row(x, i):
        before = F.get(F.col("o"), i - 1)["o_orderstatus"]
        same = F.size(F.filter("o", lambda y: y["o_orderstatus"] == x["o_orderstatus"]))
        status = F.when((i > 0) & (before == x["o_orderstatus"]), "").otherwise(F.concat(F.lit("<td rowspan="), same.cast("string"), F.lit(">"), x["o_orderstatus"], F.lit("</td>")))
        key = x["o_orderkey"].cast("string")
        return F.concat(F.lit("<tr>"), status, F.lit("<td>&#35;<b>"), key, F.lit("</b> <a href='https://shop.example.com/"), key, F.lit(".git'>order</a><td>"), x["o_orderpriority"], F.lit("</tr>"))

    inner = F.concat(F.lit("<table><tr><th>status</th><th> order </th><th>priority</th></tr>"), F.array_join(F.transform("o", row), ""), F.lit("</table>"))
    return orders.select("page_id", F.concat(F.lit("<html><!-- <table> --><table><tr><th>name</th></tr><tr><td>x "), inner, F.lit("</td></tr></table>")).alias("html"))


def html_table_rows(spark, sf_dir):
    rows = html_tables.table_rows(tables_of(spark, sf_dir), "page_id")
    best = html_tables.best_table(stored(rows, "table_rows"), "page_id", {"name": 3, "order": 3, "status": 3})
    return best.select("page_id", html_tables.cell("status").alias("status"), html_tables.cell("order").alias("name"), html_tables.cell("order", "url").alias("url"), html_tables.cell("priority").alias("priority"), "score")


LIBRARIES = [("en", "english", False), ("fr", "french", True), ("de", "german", True), ("example", "sample", True)]
VENDORS, HOLDERS = ("spam-farm", "m"), ("blog",)


def library_paths(spark, sf_dir):
    """Addresses of pages as paths (host cut at its dots): folders of languages as libraries, some only in a dependency."""
    files = table(spark, sf_dir, "pages").select(F.lit("web").alias("repo"), "page_id", F.replace(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.lit("."), F.lit("/")).alias("path"))
    registry = spark.createDataFrame(LIBRARIES, "segment string, library string, needs_context boolean")
    return libraries.library_of(files, registry, None, VENDORS, HOLDERS).select("page_id", "library", "basis")


def code_of(spark, sf_dir) -> DataFrame:
    """A repository per nation with a C file per supplier: a function whose names and numbers are its own, with as many more
    statements as the remainder of its key says; a macro and a function too short to count."""
    k = F.col("s_suppkey")
    n, m = k.cast("string"), F.pmod(k, F.lit(7)).cast("int")
    more = F.expr("repeat(concat('  total_', s_suppkey, ' += ', s_suppkey, ';\n'), cast(s_suppkey % 7 as int))")
    head = F.concat(F.lit("// supplier { of ( "), n, F.lit("\nint f_"), n, F.lit("(int a_"), n, F.lit(", char *b)\n{\n  int total_"), n, F.lit(" = 0;\n"))
    loop = F.concat(F.lit("  for (int i = 0; i < "), m.cast("string"), F.lit("; i++) {\n    total_"), n, F.lit(" += g_"), m.cast("string"), F.lit("(a_"), n, F.lit(", i); /* } */\n  }\n"))
    tail = F.concat(F.lit("  if (total_"), n, F.lit(" > 10) {\n    return total_"), n, F.lit(';\n  }\n  log_it("a brace { and '), n, F.lit('");\n  return 0;\n}\n\n#define LIMIT 10\nstatic void tiny(void) { }\n'))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(k.alias("doc_id"), F.col("n_name").alias("source"), F.concat(F.lit("k/s"), n, F.lit(".c")).alias("path"), F.lit("c").alias("lang"), F.concat(head, loop, more, tail).alias("text"))


def described_functions(spark, sf_dir) -> DataFrame:
    return stored(code_rows.described(code_rows.functions(code_of(spark, sf_dir))), "functions")


def code_functions(spark, sf_dir):
    """Functions of C files with their lines, parameters and what they do."""
    rows = described_functions(spark, sf_dir)
    return rows.select("doc_id", "name", "kind", "start_line", "end_line", "params", F.array_join("features", ",").alias("features"), F.array_join("control", ",").alias("control"), F.array_join("strings", ",").alias("strings"))


def code_segments(spark, sf_dir):
    """The segments of these functions: each block of a control statement, other runs of statements, short ones joined."""
    cut = code_rows.segments(code_rows.functions(code_of(spark, sf_dir)).select("doc_id", "lang", "start_line", "code"))
    return cut.groupBy("doc_id").agg(F.min("seg_start").alias("first"), F.max("seg_end").alias("last"), F.sum(F.col("seg_end") - F.col("seg_start") + 1).alias("covered"))


def code_clones(spark, sf_dir):
    """For functions whose key is divisible by 50, the first of each other repository that is the same but for names."""
    return code_rows.normal_matches(described_functions(spark, sf_dir), F.col("doc_id") % 50 == 0)


QUERIES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (make_outputs, html_table_rows, library_paths, code_functions, code_segments, code_clones)}

_REGISTRY = ", ".join(f"('{s}', '{n}', {c})" for s, n, c in LIBRARIES)

ORACLE: dict[str, str] = {
    "code_functions": """select s_suppkey as doc_id, 'f_' || s_suppkey as name, 'function' as kind, 2::int as start_line, (13 + s_suppkey % 7)::int as end_line, 2::int as params,
  'call:f_' || s_suppkey || case when 'g_' || s_suppkey % 7 < 'log_it' then ',call:g_' || s_suppkey % 7 || ',call:log_it' end || ',cf:for,cf:if,cf:return,ty:char,ty:int' as features, 'for,if,return' as control, 'a brace { and ' || s_suppkey as strings from supplier""",
    "code_segments": """with f as (select s_suppkey as k, s_suppkey % 7 as m from supplier)
select k as doc_id, case when m < 3 then 2 else 4 end::int as first, case when m < 3 then 13 + m else 12 + m end::int as last, case when m < 3 then 12 + m else 9 + m end::bigint as covered from f""",
    "code_clones": """with f as (select s_suppkey as k, n_name as source, s_suppkey % 7 as m from supplier join nation on s_nationkey = n_nationkey)
select q.k as q_id, c.source, min(c.k) as c_id from f q join f c on q.m = c.m and (q.m = 0 or (q.k <= 10) = (c.k <= 10)) and q.source <> c.source where q.k % 50 = 0 group by 1, 2""",
    "make_outputs": """with s as (select r_name as repo, n_nationkey as n, s_suppkey as k from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
rv as (select repo, min((n, k)) as x from s where k % 5 = 0 group by repo), la as (select repo, min((n, k)) as x from s where k % 5 <> 0 and k % 3 = 0 group by repo)
select repo, 'kernel-rv' as output, 'target' as via, 's/' || x[2] || '.mk' as path, 2::int as line, 'kernel-rv:' as excerpt from rv
union all select repo, 'kernel-la', 'recipe', 's/' || x[2] || '.mk', 2::int, 'cp out/' || x[2] || '.bin kernel-la' from la""",
    "html_table_rows": """select o_custkey as page_id, o_orderstatus as status, '#' || o_orderkey || ' order' as name, 'https://shop.example.com/' || o_orderkey as url, o_orderpriority as priority, 8::int as score from orders""",
    "library_paths": rf"""with p as (select page_id, list_filter(string_split(lower(replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '.', '/')), '/'), lambda x: x <> '') as p from pages),
v as (select page_id, min(i) as i from (select page_id, unnest(range(1, len(p))) as i, p from p) where p[i] in {VENDORS} group by 1),
s as (select page_id, unnest(range(1, len(p) + 1)) as i, p from p),
r as (select page_id, library, i from s join (values {_REGISTRY}) r(segment, library, needs) on s.p[i] = segment where not needs or len(list_filter(p[1:i - 1], lambda x: x in {VENDORS} or x = '{HOLDERS[0]}')) > 0 or (i = 1 and coalesce(p[2] = 'src', false))),
g as (select page_id, min_by(library, i) as library from r group by 1)
select page_id, coalesce(p.p[v.i + 1], g.library) as library, case when v.i is not null then 'vendor' when g.library is not null then 'segment' end as basis from p left join v using (page_id) left join g using (page_id)""",
}
