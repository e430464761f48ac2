"""Sources: repository trees, change logs, catalogs and tables in text, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.paths import is_excluded, is_test_path, language
from kinfolk.functions.text import norm_hash, raw_hash, url_identity

FIELD = "\x1f"


def source_files(spark: SparkSession, root: str, max_lines: int = 10_000) -> DataFrame:
    """path, lang, text, n_lines, norm_hash, raw_hash of the source files under root; tests, excluded folders, other
    languages and files of more than max_lines lines stay out. Invalid bytes become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.when(F.startswith(rel, F.lit(root.rstrip("/") + "/")), F.substring(rel, F.lit(len(root.rstrip("/")) + 2), F.length(rel))).otherwise(rel)
    rows = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).withColumn("lang", language(F.col("path")))
    rows = rows.filter(F.col("lang").isNotNull() & ~is_test_path(F.col("path")) & ~is_excluded(F.col("path")))
    rows = rows.withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.when(F.endswith("text", F.lit("\n")), 0).otherwise(1))
    return rows.filter(F.col("n_lines") <= max_lines).withColumn("norm_hash", norm_hash(F.col("text"))).withColumn("raw_hash", raw_hash(F.col("text")))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of an exported log: a header line "@@@" sha, dates, author, subject parted by unit separators, then a line of
    added, deleted and path parted by tabs for each file. Sizes of files marked "-" are unknown (null), not 0.

    Every log file is one row of text, cut at its headers, so no order across lines is needed.
    """
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), "value")
    parts = logs.select("log", F.posexplode(F.filter(F.split("value", "(?m)^@@@"), lambda x: F.btrim(x) != "")).alias("seq", "part"))
    head, rest = F.split(F.substring_index("part", "\n", 1), FIELD), F.filter(F.slice(F.split("part", "\n"), F.lit(2), F.size(F.split("part", "\n"))), lambda x: x != "")
    number = lambda x, k: F.get(F.split(x, "\t"), F.lit(k)).try_cast("int")
    files = F.transform(rest, lambda x: F.struct(F.get(F.split(x, "\t"), F.lit(2)).alias("path"), number(x, 0).alias("additions"), number(x, 1).alias("deletions")))
    rows = parts.select("log", "seq", head.alias("h"), files.alias("files"))
    known = F.forall("files", lambda f: f["additions"].isNotNull())
    total = F.aggregate("files", F.lit(0), lambda a, f: a + F.coalesce(f["additions"], F.lit(0)))
    return rows.select("log", "seq", F.get("h", F.lit(0)).alias("sha"), F.try_to_timestamp(F.get("h", F.lit(1))).alias("author_date"), F.get("h", F.lit(2)).alias("author"), F.get("h", F.lit(3)).alias("subject"), "files", F.when(known, total).alias("additions"), known.alias("complete"))


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the pipe tables in text files as maps of header to cell; separator rows go, short rows too."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    lines = text.select("file", F.posexplode(F.filter("lines", lambda x: F.btrim(x).startswith("|"))).alias("n", "line"))
    cells = F.transform(F.split(F.btrim(F.btrim("line"), F.lit("|")), r"\|"), lambda c: F.btrim(c))
    rows = lines.select("file", "n", cells.alias("cells")).filter(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    header = rows.filter("n = 0").select("file", F.col("cells").alias("header"))
    return rows.filter("n > 0").join(header, "file").filter("size(cells) = size(header)").select("file", "n", F.map_from_arrays("header", "cells").alias("row"))


def unique_urls(rows: DataFrame, url: str = "url", order: str = "row") -> DataFrame:
    """The first row of each repository address."""
    first = W.partitionBy(url_identity(F.col(url))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


#: What a header says above a column of addresses, and the columns that a table of repositories must have.
URL_HEADERS = ("fork", "repo", "仓库", "地址", "url")
REQUIRED_COLUMNS = {"year": "年份", "event": "赛事", "sub_event": "子赛事", "school": "学校", "team_name": "队伍名称", "repo_url": "仓库地址"}


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, n (the line, from 1) and cells of the lines of comma-separated files, quotes taken off; a quoted cell stays on
    its line. Every file is one row of text, so the numbers of its lines need no order across tasks."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("k", "line"))
    cells = F.regexp_extract_all("line", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), 1)
    bare = F.transform(cells, lambda c: F.when(F.length(c) >= 2, F.when(c.startswith('"') & c.endswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))).otherwise(c))
    whole = F.transform(F.arrays_zip(cells.alias("c"), bare.alias("b")), lambda x: F.btrim(F.coalesce(x["b"], x["c"])))
    return lines.filter(F.btrim("line") != "").select("file", (F.col("k") + 1).alias("n"), whole.alias("cells"))


def works(rows: DataFrame) -> DataFrame:
    """file, n, url, team_id of the repositories in tables of works (see csv_rows), each address once, where it stands first.

    The first row is a header if a cell of it speaks of addresses; that cell's column has them, else the first one. What is
    no http address goes. An address loses slashes at its end and .git; the team is named by its last part.
    """
    names = F.transform("cells", lambda c: F.exists(F.array(*map(F.lit, URL_HEADERS)), lambda w: F.contains(F.lower(c), w)))
    first = rows.groupBy("file").agg(F.min("n").alias("_first"), F.min_by(F.array_position(names, True), "n").alias("_at"))
    met = rows.join(first, "file").filter((F.col("n") > F.col("_first")) | (F.col("_at") == 0))
    url = F.btrim(F.get("cells", F.greatest(F.col("_at") - 1, F.lit(0)).cast("int")))
    found = met.select("file", "n", url.alias("raw")).filter(F.col("raw").rlike("(?i)^https?://"))
    clean = F.regexp_replace(F.regexp_replace("raw", "/+$", ""), r"(?i)\.git$", "")
    found = found.select("file", "n", clean.alias("url"))
    by = found.groupBy("file", F.lower("url").alias("_key")).agg(F.min(F.struct("n", "url")).alias("f"))
    path = F.rtrim(F.regexp_replace("f.url", r"[?#].*$", ""), F.lit("/"))
    return by.select("file", "f.n", "f.url", F.url_decode(F.substring_index(path, "/", -1)).alias("team_id"))


def required_columns(rows: DataFrame, names: dict[str, str] = REQUIRED_COLUMNS, key: str = "repo_url") -> DataFrame:
    """The named columns under their short names, cleaned of white space, rows without the key left out; missing columns are
    an error that names all of them."""
    missing = [n for n in names.values() if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    clean = lambda c: F.btrim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(" \t\r\n"))
    return rows.select(*(clean(n).alias(short) for short, n in names.items())).filter(F.col(key) != "")


def id_collisions(repos: DataFrame) -> DataFrame:
    """Repository ids (in any case of letters) that stand for more than one address."""
    return repos.groupBy(F.lower("repo_id").alias("repo_id")).agg(F.count_distinct(url_identity(F.col("url"))).alias("n")).filter("n > 1")


def symbol_tags(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of exported tags, a JSON object a line; lines of other types and broken ones go."""
    fields = "_type string, name string, path string, line long, end long, kind string, scope string, scopeKind string, signature string, extras string, language string"
    return spark.read.schema(fields).json(path).filter("_type = 'tag' and name is not null").drop("_type")


def log_tails(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """file and the last characters of each log: what a step's state is read from."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.right("value", F.lit(most)).alias("tail"))
