"""Token search, evidence scans with positions, catalog search, symbol lookup and call graphs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.text import words
from kinfolk.runtime import sized_join, stored


def postings(docs: DataFrame) -> DataFrame:
    """token, doc_id, line (from 1) of every distinct word of a line."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line_text"))
    return lines.select("doc_id", (F.col("k") + 1).alias("line"), F.explode(F.array_distinct(words(F.lower("line_text")))).alias("token"))


def search_all(index: DataFrame, tokens: list[str]) -> DataFrame:
    """doc_id and line of the lines that hold all the tokens."""
    hit = index.filter(F.col("token").isin(*tokens)).groupBy("doc_id", "line").agg(F.count_distinct("token").alias("n"))
    return hit.filter(F.col("n") == len(set(tokens))).select("doc_id", "line")


def evidence(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, category, n matches and first line (from 1) of each pattern that a text holds."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern")) for c, p in patterns.items())))
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rows.alias("x"))
    n = F.regexp_count("text", F.col("x.pattern"))
    before = F.substring(F.col("text"), F.lit(1), F.regexp_instr("text", F.col("x.pattern")) - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return t.select("doc_id", F.col("x.category").alias("category"), n.alias("n"), F.when(n > 0, line).alias("first_line")).filter("n > 0")


def glob_pattern(glob: str) -> str:
    """A shell pattern over whole paths as a regular expression: * for any characters, ? for one, [abc] for one of some."""
    out, k = "", 0
    while k < len(glob):
        end = glob.find("]", k + 2) if glob[k] == "[" else -1
        if end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(glob[k]) or re.escape(glob[k])
        k += 1
    return f"(?s)^{out}$"


def search_lines(files: DataFrame, pattern: str, glob: str = "*") -> DataFrame:
    """doc_id, path, line (from 1), content of the lines that match a regular expression, of files whose path matches a glob."""
    kept = files.filter(F.col("path").rlike(glob_pattern(glob)) & F.coalesce("text", F.lit("")).rlike(pattern))  # texts without a match are not cut
    lines = kept.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("k", "content"))
    return lines.filter(F.col("content").rlike(pattern)).select("doc_id", "path", (F.col("k") + 1).alias("line"), "content")


def references(calls: DataFrame, subsystem: Column) -> DataFrame:
    """symbol, subsystem, n, callers, files: where each called symbol is called from. calls: file, caller, callee."""
    rows = calls.select(F.col("callee").alias("symbol"), subsystem.alias("subsystem"), "caller", "file")
    return rows.groupBy("symbol", "subsystem").agg(F.count("*").alias("n"), F.count_distinct("caller").alias("callers"), F.count_distinct("file").alias("files"))


def subtree_edges(calls: DataFrame, prefix: str) -> DataFrame:
    """kind, n, callers, callees of the calls that touch a subtree: internal, outgoing and incoming. A symbol is in the
    subtree if a file under the prefix defines it, that is, calls from it. calls: file, caller, callee."""
    inside = F.startswith("file", F.lit(prefix))
    own = stored(calls.filter(inside).select(F.col("caller").alias("callee")).distinct().withColumn("_own", F.lit(True)), "subtree")
    met = sized_join(calls, own, "callee", "left").withColumn("kind", F.when(inside & F.col("_own").isNotNull(), "internal").when(inside, "outgoing").when(F.col("_own").isNotNull(), "incoming"))
    return met.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))


#: Marks the start of a match inside a text; taken out of texts that have it.
MARK = "\x01"
EXCERPT = 280


def findings(docs: DataFrame, signals: list[tuple[str, str, float]], by_file: tuple[str, ...] = ()) -> DataFrame:
    """finding, doc_id, category, line, excerpt, confidence, lines, hits: every place where a signal's pattern matches.

    signals: category, pattern, confidence; patterns may span lines, a match counts where it starts. Of several matches of
    a category on one line the first signal's counts, once. Categories in by_file give one row a text, with all their lines.
    The starts of matches are marked in the text before it is cut into lines, so the work grows with the text alone.
    """
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("category"), F.lit(p).alias("pattern"), F.lit(float(w)).alias("confidence")) for k, (c, p, w) in enumerate(signals))))
    t = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit("")).alias("text"), rows.alias("x"))
    marked = F.split(F.regexp_replace("text", F.col("x.pattern"), F.lit(f"{MARK}$0")), r"\r\n|[\n\r]")
    at = F.filter(F.transform(marked, lambda line, i: F.struct((i + 1).alias("line"), line.alias("text"))), lambda s: F.contains(s["text"], F.lit(MARK)))
    shown = F.substring(F.btrim(F.regexp_replace(F.replace("h.text", F.lit(MARK), F.lit("")), r"\s+", " ")), 1, EXCERPT)
    hits = t.select("doc_id", "x", F.explode(at).alias("h")).select("doc_id", "x.category", "h.line", F.struct("x.k", shown.alias("excerpt"), "x.confidence").alias("s"))
    each = hits.groupBy("doc_id", "category", "line").agg(F.min("s").alias("s"))
    whole = F.col("category").isin(*by_file) if by_file else F.lit(False)
    key = F.when(~whole, F.col("line"))
    out = each.groupBy("doc_id", "category", key.alias("_line")).agg(F.min(F.struct("line", "s")).alias("f"), F.array_sort(F.collect_list("line")).alias("lines"))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("f.line").cast("string"), "category")
    return out.select(name.alias("finding"), "doc_id", "category", "f.line", "f.s.excerpt", "f.s.confidence", "lines", F.size("lines").alias("hits"))


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """root, node, depth: the least number of calls from a root, up to depth. One join per level over new nodes only."""
    found = stored(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "reach")
    front = found
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("caller")).select("root", F.col("callee").alias("node")).distinct()
        front = stored(step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def catalog_search(items: DataFrame, columns: list[str], query: str, reports: DataFrame, key: str) -> DataFrame:
    """Items with the query in one of the columns, or in a report of theirs (reports: key, body)."""
    like = F.lit(False)
    for c in columns:
        like = like | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    in_reports = reports.filter(F.contains(F.lower("body"), F.lit(query.lower()))).select(key).distinct().withColumn("_in", F.lit(True))
    return items.join(in_reports, key, "left").filter(like | F.col("_in").isNotNull()).drop("_in")


def symbol_lookup(symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Symbols by exact name before those that hold it, definitions before others."""
    exact = F.when(F.col("name") == name, 0).when(F.contains(F.lower("name"), F.lit(name.lower())), 1)
    return symbols.withColumn("_r", exact).filter("_r is not null").orderBy("_r", F.when(F.col("kind") == "definition", 0).otherwise(1), "file", "line").limit(limit).drop("_r")


def latest_run(lines: DataFrame, marker: Column) -> DataFrame:
    """The lines of each log from its last start marker on (log, n, text)."""
    start = lines.groupBy("log").agg(F.max(F.when(marker, F.col("n"))).alias("_start"))
    return lines.join(start, "log").filter(F.col("n") >= F.coalesce("_start", F.lit(0))).drop("_start")
