"""Citations of reports: commits by prefixes of their hashes, files and folders by paths, and texts that are not complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.paths import LANGUAGES
from kinfolk.functions.text import let, visible_text
from kinfolk.runtime import stored

SHORT, LONG = 7, 12
#: Endings of a cited file, if the caller names no others: those of the languages that are read as source.
ENDINGS = tuple(LANGUAGES)


def resolved_commits(cited: DataFrame, commits: DataFrame) -> DataFrame:
    """cited, sha, n: the commits that each cited prefix of at least seven hex digits stands for; sha is null unless n is 1.

    A citation longer than twelve digits that no commit has is tried with its first twelve. Both sides meet on the first
    seven digits, so a commit is compared with the citations of its seven digits only.
    """
    low = F.lower(F.btrim(F.col("cited")))
    asked = cited.select("cited").distinct().withColumn("low", low)
    fine = asked.filter(F.col("low").rlike(f"^[0-9a-f]{{{SHORT},}}$")).withColumn("head", F.substring("low", 1, SHORT))
    all_ = commits.select("sha", F.substring(F.lower("sha"), 1, SHORT).alias("head"))
    met = fine.join(all_, "head")
    whole = F.startswith(F.lower("sha"), F.col("low"))
    part = (F.length("low") > LONG) & F.startswith(F.lower("sha"), F.substring("low", 1, LONG))
    by = met.groupBy("cited").agg(F.count_if(whole).alias("a"), F.min(F.when(whole, F.col("sha"))).alias("x"), F.count_if(part).alias("b"), F.min(F.when(part, F.col("sha"))).alias("y"))
    n = F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b"))
    by = by.select("cited", n.alias("n"), F.when(n == 1, F.coalesce("x", "y")).alias("sha"))
    return asked.select("cited").join(by, "cited", "left").select("cited", "sha", F.coalesce("n", F.lit(0)).alias("n"))


def _names(text: Column) -> Column:
    """The pieces of a text made of the characters of paths, without the dots and dashes that end a sentence."""
    return F.transform(F.split(text, r"[^\w./\-]+|[^\x00-\x7F]+"), lambda x: F.rtrim(x, F.lit(".-")))


def cited_paths(text: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    """The distinct file paths of a text, by their endings; line numbers are left out."""
    return F.array_distinct(F.filter(_names(text), lambda x: (F.locate(".", x) > 0) & F.substring_index(x, ".", -1).isin(*endings) & (F.length(F.substring_index(x, "/", -1)) > F.length(F.substring_index(x, ".", -1)) + 1)))


def cited_folders(text: Column) -> Column:
    """The distinct folders of a text: two parts or more, with a slash at the end and none at the start."""
    parts = lambda x: F.slice(F.split(x, "/"), 1, F.size(F.split(x, "/")) - 1)
    return F.array_distinct(F.filter(_names(text), lambda x: x.endswith("/") & (F.size(parts(x)) >= 2) & F.forall(parts(x), lambda y: y != "")))


def suffixes(path: Column) -> Column:
    """A path and what is left of it as its first parts go, one after the other."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def checked_citations(reports: DataFrame, files: DataFrame) -> DataFrame:
    """report, cited, kind (file or folder), found: a file is found if it or a suffix of its path is in files (path), a folder
    if it is a folder on the path of some file."""
    t = F.coalesce("text", F.lit(""))
    cited = reports.select("report", F.explode(F.concat(F.transform(cited_paths(t), lambda p: F.struct(p.alias("cited"), F.lit("file").alias("kind"))), F.transform(cited_folders(t), lambda p: F.struct(p.alias("cited"), F.lit("folder").alias("kind"))))).alias("x")).select("report", "x.*")
    tried = cited.select("report", "cited", "kind", F.explode(F.when(F.col("kind") == "file", suffixes(F.col("cited"))).otherwise(F.array(F.rtrim(F.col("cited"), F.lit("/"))))).alias("path"))
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path"), F.lit("folder").alias("kind"), parts.alias("p")).filter(F.size("p") > 1)
    there = files.select("path", F.lit("file").alias("kind")).union(folders.select("path", "kind")).distinct().withColumn("_there", F.lit(True))
    met = tried.join(there, ["path", "kind"], "left")
    return met.groupBy("report", "cited", "kind").agg(F.bool_or(F.coalesce("_there", F.lit(False))).alias("found"))


#: Words by which a report says that a part of it was not made, and the characters shown around an ellipsis.
MARKERS = (
    "未启用 LLM 语义分析",
    "当前未启用语义模型",
    "LLM 聚合失败",
    "LLM 评判失败",
    "LLM 顶层评判失败",
    "当前为规则兜底",
    "使用规则兜底",
    "正文与模块缺失",
    "⚠ 聚合失败",
    "AI 模型检测未完成",
    "AI 检测产物中没有整体统计",
)
AROUND = 28
#: Ways of hiding text that does not fit, by the style or chart setting that does it.
HIDING = {"ellipsis style": r"(?i)text-overflow\s*:\s*ellipsis", "line clamp": r"(?i)-webkit-line-clamp\s*:", "truncated labels": r"""(?i)["']overflow["']\s*:\s*["']truncate["']"""}


def ellipses(html: Column) -> Column:
    """The places of a page's visible text, source code left out, where an ellipsis stands for something: each with the
    characters around it. More or fewer than three dots are no ellipsis."""
    text = visible_text(html)
    # the text between ellipses; one of three dots stands alone, a longer run of dots stays text
    pieces = F.split(text, r"…|(?<!\.)\.{3}(?!\.)")
    marks = F.regexp_extract_all(text, F.lit(r"(…|(?<!\.)\.{3}(?!\.))"), 1)

    def places(t: Column, p: Column, m: Column) -> Column:
        def at(k: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), k), F.lit(0), lambda n, i: n + F.length(F.get(p, i)) + F.when(i < k, F.length(F.get(m, i))).otherwise(0))

        def context(x: Column, k: Column) -> Column:
            start = F.greatest(at(k) - AROUND, F.lit(0))
            return F.btrim(F.substring(t, start + 1, at(k) + F.length(x) + AROUND - start))

        return F.transform(m, context)

    return let(F.struct(text.alias("t"), pieces.alias("p"), marks.alias("m")), lambda x: places(x["t"], x["p"], x["m"]))


def flaws(html: Column) -> Column:
    """What keeps a report from being complete, in order: markers of parts not made, ellipses, hidden text."""
    text = visible_text(html)
    markers = let(text, lambda t: F.filter(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(t, m)))
    hidden = F.filter(F.array(*(F.when(html.rlike(p), F.lit(name)) for name, p in HIDING.items())), lambda x: x.isNotNull())
    named = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what")))
    return F.concat(named("marker", markers), named("ellipsis", ellipses(html)), named("hidden", hidden))


def incomplete(text: Column) -> Column:
    """Whether a report is empty or has flaws, or holds a template's placeholder."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return (bare == "") | bare.rlike(r"\{\{[^}]*\}\}") | bare.rlike(r"^(TODO|TBD|FIXME)\b") | (F.size(flaws(bare)) > 0)


#: JSON of values that say there is no error.
FALSE = ('""', "0", "0.0", "false", "null", "[]", "{}")


def error_markers(reports: DataFrame, key: str, json: str, name: str = "_error", most_depth: int = 100) -> DataFrame:
    """key, path, message: every object inside a report's JSON that has an error of that name, wherever it is nested.

    The JSON is descended a level at a time: objects and lists of a level become the rows of the next, with their paths,
    so no depth is built into the plan; nesting beyond most_depth raises. Empty and false messages are no errors; broken
    and null JSON has none.
    """
    if key in ("pos", "key", "value"):
        raise ValueError("the key column has the name of a column of the descent")
    level = reports.select(key, F.lit("report").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    found = None
    for _ in range(most_depth):
        kind = F.schema_of_variant("v")
        here = stored(level.select(key, "path", F.to_json("v").alias("j"), kind.startswith("OBJECT").alias("is_object")).filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "nodes")
        nodes = here.select(key, "path", "is_object", F.parse_json("j").alias("v"))
        said = F.try_variant_get("v", f"$.{name}", "variant")
        errors = nodes.filter("is_object").filter(F.coalesce(~F.to_json(said).isin(*FALSE), F.lit(False))).select(key, "path", F.try_variant_get("v", f"$.{name}", "string").alias("message"))
        found = errors if found is None else found.unionByName(errors)
        if here.isEmpty():
            return found
        spark = reports.sparkSession
        children = nodes.select(key, "path", "is_object", F.col("v").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(key, "path", "is_object", "pos", F.col("key").alias("_name"), F.col("value").alias("v"))
        at = F.when(F.col("is_object"), F.concat("path", F.lit("."), "_name")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = children.filter(~F.col("is_object") | (F.col("_name") != name)).select(key, at.alias("path"), "v")
    raise ValueError(f"JSON nested deeper than {most_depth}")


def audit(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: wanted reports, those that are there, missing and incomplete. reports: report, text; wanted: report."""
    met = wanted.select("report").distinct().join(reports.withColumn("_there", F.lit(True)), "report", "left")
    return met.agg(F.count_distinct("report").alias("wanted"), F.count_if("_there").alias("present"), F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if(F.col("_there") & incomplete(F.col("text"))).alias("incomplete"))
