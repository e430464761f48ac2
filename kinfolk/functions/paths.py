"""Path and repository predicates as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Languages by extension; words that mark tests and benchmarks between - _ and . of a name; whole names that
#: do; folders that hold no source of a repository's own, by name, end and part of a name.
LANGUAGES = {"rs": "rust", "c": "c", "h": "c", "S": "asm", "s": "asm", "asm": "asm"}
TEST_WORDS = ("test", "tests", "testing", "testcase", "testcases", "testdata", "bench", "benches", "benchmark", "benchmarks")
TEST_NAMES = ("libctest", "libc-test", "test-suite", "test-suites", "testsuite", "testsuites")
EXCLUDED_DIRS = (
    "target", "build", ".git", "vendor", "third_party", "third-party",
    "node_modules", ".cargo", "deps", "dependencies",
    "libc-test", "oscomp", "user_c_program", "testsuits", "testsuites",
    "lmbench", "busybox", "iozone", "ltp", "lua",
    "netperf", "iperf", "unixbench", "rt-tests", "byte-unixbench",
    "sysroot", "rootfs",
)
EXCLUDED_ENDS = ("-musl-cross", "-gcc-cross", "-elf-cross")
EXCLUDED_PARTS = ("busybox", "ltp-full", "ltp_full")


def language(path: Column) -> Column:
    """Language by extension; null for any other file."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    return F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[ext]


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Text in the compatibility form of Unicode (NFKC), without difference of case: full-width letters as plain ones."""
    return text.map(lambda x: None if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


def parts_of(path: Column) -> Column:
    """The parts of a path in lower case, either slash between them; no empty parts and no dots."""
    return F.filter(F.split(F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))


def _is_test_name(name: Column) -> Column:
    return name.isin(*TEST_NAMES) | F.arrays_overlap(F.split(name, r"[-_.]+"), F.array(*map(F.lit, TEST_WORDS)))


def is_test_path(path: Column) -> Column:
    """Whether a folder on a path, or its file without the last ending, has a test word between - _ and . or is named as
    test collections are ("latest" and "contest" are no test words). Paths beyond ASCII: give them through compatible()."""
    parts = parts_of(path)
    stem = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.coalesce(F.exists(folders, _is_test_name) | _is_test_name(stem), F.lit(False))


def is_excluded(path: Column) -> Column:
    """Whether one of the folders on the path holds no source of its own: by name, by how it ends, by a part of it, or as tests."""
    parts = parts_of(path)
    excluded = lambda x: x.isin(*EXCLUDED_DIRS) | x.rlike("(?:" + "|".join(map(re.escape, EXCLUDED_ENDS)) + ")$") | x.rlike("|".join(map(re.escape, EXCLUDED_PARTS))) | _is_test_name(x)
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), excluded)


def root_key(name: Column) -> Column:
    """A name by its letters and digits alone, in compatible form: what spellings of one root have in common."""
    return F.regexp_replace(compatible(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def is_baseline(repo: Column) -> Column:
    return F.element_at(F.split(F.replace(F.btrim(repo), F.lit("\\"), F.lit("/")), "/"), -1).startswith("baseline_")


def repo_year(repo: Column) -> Column:
    return F.expr("null").cast("int") if repo is None else F.regexp_extract(repo, r"^(\d{4})/", 1).try_cast("int")


def has_segments(path: Column, segments: Column) -> Column:
    """Whether whole path parts of segments follow each other in path."""
    return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.concat(F.lit("/"), segments, F.lit("/")))


def cross_language(a: Column, b: Column) -> Column:
    return F.coalesce((F.lower(a) != F.lower(b)), F.lit(False))
