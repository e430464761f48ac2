"""Static scan of makefiles: which of the required outputs a repository's makefiles declare, without running make.

From the entry file of each repository the search follows include lines across files, level by level. What a name means
depends on the files read before, so a level is read per repository in the order in which its files were first asked
for, with the variables of all levels before; a task never holds more than the statements of one repository's level. An
output is declared by a rule of its name, else by a command of any rule that makes it; the first place in reading order
counts. Files that include each other are read once; a search deeper than MOST_LEVELS raises.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.operators.matching import bounded
from kinfolk.runtime import stored

#: Names of an entry file, the better first; required outputs; targets that build everything; commands that
#: make a file of the name they are given, at most so many characters before it; how often variables are put in.
ENTRY_NAMES = ("GNUmakefile", "makefile", "Makefile")
REQUIRED = ("kernel-rv", "kernel-la")
AGGREGATES = ("all", "submit")
COMMANDS, REACH = ("cp", "mv", "install", "objcopy", "ln"), 80
EXPANSIONS, EXCERPT = 6, 280
MOST_LEVELS = 64

_NAME, _WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*"), re.compile(r"\w+")
_VARIABLE = re.compile(r"\$(?:\((?P<round>[^(){}]+)\)|\{(?P<curly>[^(){}]+)\})")
_INCLUDES = ("include", "-include", "sinclude")


def logical_lines(text: str) -> list[tuple[int, str]]:
    """Lines with continuations joined by a space, and the line each starts on."""
    out: list[tuple[int, str]] = []
    open_ = False
    for k, raw in enumerate(text.splitlines(), 1):
        line = raw.rstrip()
        more = line.endswith("\\")
        body = line.removesuffix("\\")
        if open_:
            out[-1] = (out[-1][0], f"{out[-1][1]} {body}")
        else:
            out.append((k, body))
        open_ = more
    return out


def assignment(line: str) -> tuple[str, str] | None:
    """Name and value, where a line sets a variable."""
    name, sign, value = line.partition("=")
    name = name.strip()
    if sign and name[-1:] in (":", "?", "+"):
        name = name[:-1].rstrip()
    return (name, value.strip()) if sign and _NAME.fullmatch(name) else None


def statements(text: str) -> list[tuple[int, str, str, str]]:
    """Line, kind (set, include, rule or recipe), name and value of the statements of a makefile, comments left out.

    A recipe follows a rule or another recipe; a line may set a variable and be something else as well.
    """
    out, in_rule = [], False
    for k, raw in logical_lines(text):
        line = raw.split("#", 1)[0]
        if found := assignment(line):
            out.append((k, "set", *found))
        line = line.rstrip()
        if not line:
            continue
        if line.startswith("\t") and in_rule:
            out.append((k, "recipe", "", line.strip()))
            continue
        in_rule = False
        word, *rest = line.split(None, 1)
        if word in _INCLUDES and rest:
            out.append((k, "include", "", rest[0]))
            continue
        head, colon, after = line.partition(":")
        if colon and head.strip() and "=" not in head and not after.startswith("="):
            out.append((k, "rule", "", head.strip()))
            in_rule = True
    return out


def expanded(value: str, variables: dict[str, str]) -> str:
    """A value with the known variables in it put in, to a limited depth; unknown ones and functions stay as they are."""
    for _ in range(EXPANSIONS):
        done = _VARIABLE.sub(lambda m: variables.get(m["round"] or m["curly"], m[0]), value)
        if done == value:
            break
        value = done
    return value


def included_path(current: str, token: str) -> str | None:
    """The file an include line names, from the folder of the file it is in; null outside the repository or with patterns."""
    token = token.strip().strip("\"'")
    if not token or any(c in token for c in "$%*?["):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(current), token))
    return None if path.startswith(("/", "..")) else path


def makes(recipe: str, output: str) -> bool:
    """Whether a command in a recipe is given the output's name as a word of its own."""
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(recipe)]
    ends = [e for _, e, w in words if w in COMMANDS]
    starts = {s for s, _, _ in words}
    stops = {e for _, e, _ in words}
    at = recipe.find(output)
    while at >= 0:
        if at in starts and at + len(output) in stops and any(0 <= at - e <= REACH for e in ends):
            return True
        at = recipe.find(output, at + 1)
    return False


_STATEMENT = pa.schema([("repo", pa.string()), ("path", pa.string()), ("k", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string())])
_READ = pa.schema([("repo", pa.string()), ("kind", pa.string()), ("ord", pa.int64()), ("k", pa.int32()), ("path", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("value", pa.string())])
_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def parsed(files: DataFrame) -> DataFrame:
    """The statements of all files: repo, path, k (their order in the file), line, kind, name, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            rows = []
            for repo, path, text in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "text"))):
                rows += [(repo, path, k, *s) for k, s in enumerate(statements(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, _STATEMENT)], schema=_STATEMENT)

    return files.select("repo", "path", "text").mapInArrow(run, _ddl(_STATEMENT))


def read_level(level: pa.Table, known: pa.Table) -> pa.Table:
    """What a level of one repository says: variables as they are after it, includes, rules and recipes with theirs put in."""
    variables = dict(zip(known.column("name").to_pylist(), known.column("value").to_pylist()))
    rows = sorted(level.to_pylist(), key=lambda r: (r["ord"], r["k"]))
    out, at = [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["ord"] == rows[at]["ord"]:
            end += 1
        one = rows[at:end]
        for r in one:  # a file's variables hold in all of it
            if r["kind"] == "set":
                variables[r["name"]] = expanded(r["value"], variables)
        for r in one:
            if r["kind"] == "include":
                paths = [included_path(r["path"], token) for token in expanded(r["value"], variables).split()]
                out += [{**r, "kind": "include", "k": r["k"], "name": p, "value": str(n)} for n, p in enumerate(paths) if p is not None]
            elif r["kind"] in ("rule", "recipe"):
                out.append({**r, "value": expanded(r["value"], variables)})
        at = end
    repo = (rows or known.to_pylist())[0]["repo"]
    blank = {"repo": repo, "kind": "set", "ord": -1, "k": 0, "path": None, "line": None}
    out += [{**blank, "name": n, "value": v} for n, v in variables.items()]
    return pa.Table.from_pylist([{f.name: r[f.name] for f in _READ} for r in out], schema=_READ)


def reading_order(files: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow the include lines: the files read (repo, path, ord) and what they say (see read_level), level by level."""
    said = stored(parsed(files), "makefile_statements")
    there = files.select("repo", "path").distinct()
    frontier = stored(entries.select("repo", "path").join(there, ["repo", "path"], "left_semi").withColumn("ord", F.lit(0).cast("long")), "frontier")
    visited, read = frontier, None
    known = frontier.limit(0).select("repo", F.lit("").alias("name"), F.lit("").alias("value"))
    for _ in range(MOST_LEVELS):
        level = said.join(frontier, ["repo", "path"])
        known = known.join(frontier.select("repo").distinct(), "repo", "left_semi")
        now = stored(level.groupBy("repo").cogroup(known.groupBy("repo")).applyInArrow(lambda a, b: read_level(a, b), _ddl(_READ)), "level")
        known = now.filter("kind = 'set'").select("repo", "name", "value")
        rest = now.filter("kind <> 'set'")
        read = rest if read is None else read.unionByName(rest)
        asked = now.filter("kind = 'include'").select("repo", F.col("name").alias("path"), F.struct("ord", "k", F.col("value").cast("int").alias("n")).alias("at"))
        first = asked.groupBy("repo", "path").agg(F.min("at").alias("at")).join(there, ["repo", "path"], "left_semi").join(visited.select("repo", "path"), ["repo", "path"], "left_anti")
        base = visited.groupBy("repo").agg((F.max("ord") + 1).alias("base"))
        place = F.expr("row_number() over (partition by repo order by at)")  # the files one level of a repository asks for
        frontier = stored(first.join(base, "repo").select("repo", "path", (F.col("base") + place - 1).cast("long").alias("ord")), "frontier")
        if frontier.isEmpty():
            return visited, read
        visited = visited.unionByName(frontier)
    raise RuntimeError(f"includes deeper than {MOST_LEVELS} levels")


def entry_files(files: DataFrame) -> DataFrame:
    """repo, path of the makefile at each repository's root that make would take."""
    rank = F.array_position(F.array(*map(F.lit, ENTRY_NAMES)), F.col("path"))
    return files.filter(F.col("path").isin(*ENTRY_NAMES)).groupBy("repo").agg(F.min_by("path", rank).alias("path"))


def declared_outputs(files: DataFrame, required: tuple[str, ...] = REQUIRED, entries: DataFrame | None = None) -> DataFrame:
    """repo, output, via (target or recipe), path, line, excerpt of the first declaration of each required output.

    files: repo, path (with /), text. Outputs that no makefile declares have no row; a null text is empty.
    """
    visited, read = reading_order(files, entry_files(files) if entries is None else entries)
    names = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: F.rtrim(x, F.lit("&")))
    makes_ = F.udf(lambda recipe: [o for o in required if makes(recipe, o)], "array<string>", useArrow=True)
    rules = read.filter("kind = 'rule'").withColumn("names", names)
    by_name = rules.select("repo", F.explode(F.array_intersect(F.array_distinct("names"), F.array(*map(F.lit, required)))).alias("output"), F.lit("target").alias("via"), "ord", "k", "path", "line", F.concat(F.array_join("names", " "), F.lit(":")).alias("excerpt"))
    by_command = read.filter("kind = 'recipe'").select("repo", F.explode(makes_("value")).alias("output"), F.lit("recipe").alias("via"), "ord", "k", "path", "line", F.col("value").alias("excerpt"))
    first = F.min(F.struct((F.col("via") != "target").alias("later"), "ord", "k", "via", "path", "line", "excerpt")).alias("f")
    best = by_name.unionByName(by_command).groupBy("repo", "output").agg(first)
    return best.select("repo", "output", "f.via", "f.path", "f.line", F.substring("f.excerpt", 1, EXCERPT).alias("excerpt"))


def aggregate_targets(read: DataFrame) -> DataFrame:
    """repo, targets: those of the targets that build everything which a repository's makefiles have, in order of name."""
    found = read.filter("kind = 'rule'").select("repo", F.explode(F.split("value", r"\s+")).alias("name")).withColumn("name", F.rtrim("name", F.lit("&")))
    return found.filter(F.col("name").isin(*AGGREGATES)).groupBy("repo").agg(F.array_sort(F.collect_set("name")).alias("targets"))
