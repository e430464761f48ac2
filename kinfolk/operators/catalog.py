"""Catalog and repository facts: pages of a catalog, summaries by year and author, standard sets, callers, provenance by path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.text import name_tokens
from kinfolk.operators.matching import list_rows
from kinfolk.runtime import sized_join, stored


def page(rows: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """A page of rows in an order; number counts from 0."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def by_kind(rows: DataFrame, kinds: list[str], newest: str, limit: int | None = None) -> DataFrame:
    """Rows by their kind in a fixed order (others last), the newest of each first."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    out = rows.orderBy(F.when(place == 0, len(kinds) + 1).otherwise(place), F.desc(newest), "id")
    return out if limit is None else out.limit(limit)


def by_year(rows: DataFrame, when: Column) -> DataFrame:
    """year and n, the latest first."""
    return rows.groupBy(F.year(when).alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


def commit_summary(commits: DataFrame, group: str, top: int = 5, last: int = 20) -> DataFrame:
    """Per group: commits, first and last time, the top authors with their commits, and the last subjects, newest first.

    commits: group, id, ts, author, subject.
    """
    total = commits.groupBy(group).agg(F.count("*").alias("n"), F.min("ts").alias("since"), F.max("ts").alias("until"))
    authors = commits.groupBy(group, "author").agg(F.count("*").alias("k"))
    first = authors.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("k"), "author"))).filter(F.col("r") <= top)
    first = first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "author", "k"))), lambda x: F.concat_ws(":", x["author"], x["k"])).alias("authors"))
    newest = commits.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("r") <= last)
    newest = newest.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "subject"))), lambda x: x["subject"]).alias("subjects"))
    return total.join(first, group, "left").join(newest, group, "left")


def standard_coverage(standard: DataFrame, found: DataFrame) -> DataFrame:
    """name, category, state of a standard set against what is found: covered, constant_only (named but not implemented),
    missing, or extra. standard: name, category; found: name, implemented."""
    by = found.groupBy("name").agg(F.bool_or("implemented").alias("implemented"))
    met = standard.join(by, "name", "full_outer")
    state = F.when(F.col("category").isNull(), "extra").when(F.col("implemented").isNull(), "missing").when(F.col("implemented"), "covered").otherwise("constant_only")
    return met.select("name", "category", state.alias("state"))


def callers(functions: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, file, caller of the functions (file, name, calls) that call one of the symbols."""
    edges = functions.select("file", F.col("name").alias("caller"), F.explode(F.array_distinct("calls")).alias("symbol"))
    return sized_join(edges, stored(symbols.select("symbol").distinct(), "symbols"), "symbol", "left_semi").select("symbol", "file", "caller")


def file_subsystem(files: DataFrame, by_content: DataFrame, words: DataFrame, other: str = "other") -> DataFrame:
    """path and subsystem: by the file's own content if known, else by the first word on its path, else other.

    by_content: path, subsystem; words: word, subsystem (a fixed dimension).
    """
    parts = files.select("path", F.posexplode(F.split(F.lower("path"), "[/._-]+")).alias("k", "word"))
    named = sized_join(parts, stored(words, "words"), "word", "inner").groupBy("path").agg(F.min_by("subsystem", F.struct("k", "subsystem")).alias("by_path"))
    met = files.select("path").join(by_content.select("path", F.col("subsystem").alias("own")), "path", "left").join(named, "path", "left")
    return met.select("path", F.coalesce("own", "by_path", F.lit(other)).alias("subsystem"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda x: x != "")


def library_context(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files with library: that of the longest root that is a prefix of the path in whole parts. roots: repo, root, library.

    Each file asks with all prefixes of its path, so this is an equi-join and not a search over roots.
    """
    parts = path_parts(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("root")))
    asked = files.select("repo", "path", F.explode(prefixes).alias("x")).select("repo", "path", "x.k", "x.root")
    known = stored(roots.select("repo", F.array_join(path_parts(F.col("root")), "/").alias("root"), "library"), "roots")
    best = sized_join(asked, known, ["repo", "root"], "inner").groupBy("repo", "path").agg(F.max_by("library", F.struct("k", "library")).alias("library"))
    return files.join(best, ["repo", "path"], "left")


def same_tree(q_path: Column, c_path: Column, root: Column) -> Column:
    """Whether both paths have a vendored root as a whole part and agree from there on, or one ends with the other's rest."""

    def rest(path: Column) -> Column:
        parts = path_parts(path)
        at = F.array_position(parts, F.lower(root))
        return F.when(at > 0, F.array_join(F.slice(parts, at + 1, F.size(parts)), "/"))

    whole = lambda p: F.concat(F.lit("/"), F.array_join(path_parts(p), "/"))
    ends = lambda p, r: (r != "") & F.endswith(whole(p), F.concat(F.lit("/"), r))
    a, b = rest(q_path), rest(c_path)
    return F.coalesce(a == b, ends(c_path, a), ends(q_path, b), F.lit(False))


def layout_paths(files: DataFrame, layout: DataFrame) -> DataFrame:
    """The files whose path has three parts in a row that a framework's layout names (root, container, child)."""
    parts = path_parts(F.col("path"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), lambda k: F.struct(F.get(parts, k - 1).alias("root"), F.get(parts, k).alias("container"), F.get(parts, k + 1).alias("child")))
    rows = files.select("path", F.explode(runs).alias("x")).select("path", "x.*")
    return sized_join(rows, stored(layout, "layout"), ["root", "container", "child"], "left_semi").select("path").distinct()


#: Queries or functions of one language that a task compares at once, and cells of their matrix that it works on at once.
NAMES_BLOCK, CELLS = 4096, 1 << 20


def best_names(q: pa.Table, c: pa.Table, least: float, keep: int) -> pa.Table:
    """q_id, c_id, source, place, same, near, size: of functions of one source, each query's best keep of those whose name
    shares parts with the query's from least on (see targeted_recall)."""
    (q_flat, q_n), (c_flat, c_n) = ((np.concatenate([*x, np.zeros(0, np.int64)]), np.array([len(p) for p in x], np.int64)) for x in (list_rows(t.column("parts").combine_chunks()) for t in (q, c)))
    column = lambda t, k: t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
    q_name, c_name, c_id = column(q, "name"), column(c, "name"), column(c, "id")
    q_lines, c_lines = (column(t, "n_lines").astype(np.float64) for t in (q, c))
    order = np.argsort(q_flat, kind="stable")
    keys, owner = q_flat[order], np.repeat(np.arange(len(q_n)), q_n)[order]  # parts of the queries and whose they are
    first, count = np.searchsorted(keys, c_flat, side="left"), np.searchsorted(keys, c_flat, side="right")
    count = count - first
    ends = np.cumsum(c_n)
    found: list[tuple[np.ndarray, ...]] = []

    def best() -> tuple[np.ndarray, ...]:
        i, j, same, near, size = (np.concatenate([f[k] for f in found]) for k in range(5))
        by = np.lexsort((c_id[j], -np.nan_to_num(size, nan=-1.0), -near, ~same, i))  # a size that is not known goes last
        at = np.arange(len(by)) - np.searchsorted(i[by], i[by], side="left")
        return tuple(x[by[at < keep]] for x in (i, j, same, near, size))

    work = np.cumsum(np.maximum(len(q_n), np.add.reduceat(np.append(count, 0), ends - c_n)))  # of every function: cells, or parts met
    lo, done = 0, 0
    while lo < len(c_n):
        hi = max(lo + 1, int(np.searchsorted(work, done + CELLS, side="right")))
        here = slice(ends[lo] - c_n[lo], ends[hi - 1])
        n = count[here]
        at = np.repeat(first[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(hi - lo), c_n[lo:hi]), n)
        shared = np.bincount(row * len(q_n) + owner[at], minlength=(hi - lo) * len(q_n)).reshape(hi - lo, len(q_n))
        near = shared / np.maximum(c_n[lo:hi, None] + q_n[None, :] - shared, 1)
        j, i = np.nonzero((shared > 0) & (near >= least))
        if len(i):
            near, j = near[j, i], j + lo
            found.append((i, j, q_name[i] == c_name[j], near, np.minimum(q_lines[i], c_lines[j]) / np.maximum(q_lines[i], c_lines[j])))
        if sum(len(f[0]) for f in found) > CELLS:
            found = [best()]
        lo, done = hi, int(work[hi - 1])
    i, j, same, near, size = best() if found else (np.zeros(0, np.int64),) * 5
    known = [pa.array(same.astype(bool)), pa.array(near.astype(np.float64)), pa.array(size.astype(np.float64), from_pandas=True)]
    return pa.table([q.column("id").take(pa.array(i)), *(c.column(k).take(pa.array(j)) for k in ("id", "source", "place")), *known], ["q_id", "c_id", "source", "place", "same", "near", "size"])


def targeted_recall(queries: DataFrame, functions: DataFrame, chosen: DataFrame, least: float = 0.25, keep: int = 80) -> DataFrame:
    """q_id, c_id, source, place, rank: in the sources chosen for a query's module, functions of its language that share
    parts of its name from least on (as equal names do); the best keep of each source: equal names, then the most shared
    parts, the most alike numbers of lines, the smallest c_id.

    queries: q_id, name, lang, module, n_lines; functions: c_id, source, name, lang, module, n_lines; chosen: module, source,
    place. The queries of a module and language and the functions of a source there meet in blocks of bounded size, of which
    only each query's best go on: names are compared with all others in a task, but no pair of them is shuffled.
    """
    parts = lambda rows, key, *more: rows.select(F.col(key).cast("long").alias("id"), "module", "lang", *more, F.xxhash64("name").alias("name"), "n_lines", F.explode(F.array(F.transform(name_tokens(F.col("name")), lambda x: F.xxhash64(x)))).alias("parts")).filter(F.size("parts") > 0)
    q = stored(parts(queries, "q_id").filter("module is not null and lang is not null"), "asked_names")
    picked = stored(chosen.select("module", "source", F.col("place").cast("int").alias("place")).dropDuplicates(["module", "source"]), "chosen")
    c = stored(sized_join(parts(functions, "c_id", "source").filter("lang is not null"), picked, ["module", "source"], "inner"), "names")
    blocks = lambda rows, n, *by: rows.groupBy(*by).agg(F.ceil(F.count("*") / NAMES_BLOCK).cast("int").alias(n))
    sizes = stored(blocks(c, "c_blocks", "module", "lang", "source").join(blocks(q, "q_blocks", "module", "lang"), ["module", "lang"]), "blocks")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["module", "lang", "source", "q_block", "c_block"]
    left = sized_join(q, sizes, ["module", "lang"], "inner").withColumn("q_block", own("q_blocks")).withColumn("c_block", every("c_blocks"))
    right = sized_join(c, sizes, ["module", "lang", "source"], "inner").withColumn("c_block", own("c_blocks")).withColumn("q_block", every("q_blocks"))
    fields = "q_id long, c_id long, source string, place int, same boolean, near double, size double"
    met = left.select(*key, "id", "name", "n_lines", "parts").groupBy(*key).cogroup(right.select(*key, "id", "name", "n_lines", "parts", "place").groupBy(*key)).applyInArrow(lambda a, b: best_names(a, b, least, keep), fields)
    order = W.partitionBy("q_id", "source").orderBy(F.desc("same"), F.desc("near"), F.desc("size"), "c_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("q_id", "c_id", "source", "place", "rank")


#: The line forms of a test log, and terminal control sequences.
CONTROL_SEQUENCE = r"\x1b\[[0-?]*[ -/]*[@-~]"
RUN_STARTED = r"\[\s*=+\s*\]\s*\[\s*utest\s*\]\s*started\b"
RUN_FINISHED = r"\[\s*=+\s*\]\s*\[\s*utest\s*\]\s*finished\b"
RUN_COUNTS = r"\[\s*=+\s*\]\s*\[\s*utest\s*\]\s*(\d+) tests from (\d+) testcase ran\."
CASE_RESULT = r"\[\s*(PASSED|FAILED)\s*\]\s*\[\s*result\s*\]\s*testcase(?: init| cleanup)?\s*\(([^)]+)\)"
FAILURE = r"\[\s*ASSERT\s*\]\s*\[\s*unit\s*\]|\[\s*FAILED\s*\]\s*\[\s*result\s*\]"
UNIT_NAME = r"utest unit name:\s*\(([^)]+)\)"


def log_lines(logs: DataFrame) -> DataFrame:
    """log, n (from 1), text of every line of logs: log, text; lines end at any line break."""
    return logs.select("log", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]")).alias("n", "text")).withColumn("n", F.col("n") + 1)


def test_runs(lines: DataFrame) -> DataFrame:
    """Per log with a test run, what its last run says and what that is worth: status passed, failed, unknown or inconsistent.

    lines: log, n, text. The run goes from the last start marker to the first end marker after it, or the end of the log;
    what other runs and other lines say does not count. A run that reports only passes and shows a failure is
    inconsistent. Otherwise it is unknown if it has no end, no counts, ran nothing or more than there is, or if its results
    are not as many, and of as many names, as it says it ran.
    """
    t = F.btrim(F.regexp_replace("text", CONTROL_SEQUENCE, ""), F.lit(" \t\r\n\x0b\f"))
    rows = lines.select("log", "n", t.alias("t"))
    starts = rows.filter(F.col("t").rlike(RUN_STARTED)).groupBy("log").agg(F.max("n").alias("start_line"), (F.count("*") - 1).alias("earlier_runs"))
    told = F.col("t").rlike("|".join((RUN_FINISHED, RUN_COUNTS, CASE_RESULT, FAILURE, UNIT_NAME)))
    said = rows.filter(told).withColumnRenamed("log", "_log")  # only lines that say something go on
    scope = starts.join(said, (F.col("log") == F.col("_log")) & (F.col("n") > F.col("start_line")), "left").drop("_log")
    stop = stored(scope.groupBy("log").agg(F.min(F.when(F.col("t").rlike(RUN_FINISHED), F.col("n"))).alias("end_line")), "run_ends")
    here = scope.join(stop, "log").withColumn("_in", F.coalesce(F.col("end_line").isNull() | (F.col("n") <= F.col("end_line")), F.lit(True)))
    case = lambda k: F.nullif(F.regexp_extract("t", CASE_RESULT, k), F.lit(""))
    count = lambda k: F.regexp_extract("t", RUN_COUNTS, k).try_cast("int")
    inside = lambda c: F.when(F.col("_in"), c)
    by = here.groupBy("log", "start_line", "end_line", "earlier_runs").agg(
        F.max_by(count(1), inside(F.when(count(1).isNotNull(), F.col("n")))).alias("ran"),
        F.max_by(count(2), inside(F.when(count(2).isNotNull(), F.col("n")))).alias("available"),
        F.count(inside(case(1))).alias("cases"),
        F.count_distinct(inside(case(2))).alias("distinct_cases"),
        F.count_if(F.col("_in") & (case(1) == "FAILED")).alias("failed_cases"),
        F.count_if(F.col("_in") & F.col("t").rlike(FAILURE)).alias("failures"),
        F.min(inside(F.when(F.col("t").rlike(FAILURE), F.col("n")))).alias("first_failure"),
        F.array_sort(F.collect_set(inside(F.nullif(F.regexp_extract("t", UNIT_NAME, 1), F.lit(""))))).alias("units"),
    )
    reported = F.when(F.col("failed_cases") > 0, "failed").when(F.col("cases") > 0, "passed").otherwise("unknown")
    ran, cases = F.col("ran"), F.col("cases")
    bad = F.col("end_line").isNull() | ran.isNull() | (ran == 0) | (ran > F.col("available")) | (cases != ran) | (F.col("distinct_cases") != ran)
    status = F.when((F.col("failures") > 0) & (F.col("reported") == "passed"), "inconsistent").when(bad, "unknown").when(F.col("failures") > 0, "failed").otherwise(F.col("reported"))
    return by.withColumn("reported", reported).withColumn("complete", F.col("end_line").isNotNull()).withColumn("status", status)


def failure_kind(log: Column) -> Column:
    """What stopped a step, by the last part of its log: quota, network or other; null if nothing tells."""
    low = F.lower(F.coalesce(log, F.lit("")))
    return F.when(low.rlike(r"quota|rate.?limit|\b429\b|insufficient balance"), "quota").when(low.rlike(r"timed? ?out|connection (reset|refused|aborted)|temporary failure|\b50[234]\b"), "network").when(low.rlike(r"traceback|\berror\b|failed"), "other")
