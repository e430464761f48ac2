"""Third-party libraries inside repositories, told by where files stand.

Three kinds of evidence, the first that holds counts: the file is under a folder that a package manifest (or an adapter
that really imports the package) makes a root of the library, the longest such root; it is under a vendor folder, and then
the next part of its path names the library; or a folder is named as a registered library is. Registered names that mean
other things as well (an architecture, say) count only where their neighbours show a dependency: a vendor folder or a
container of dependencies before them, or the name being the repository's root with sources right below.

Paths meet the registry and the roots by equality on their parts and prefixes, so a lookup is a join on one string however
deep the path, and the registry is broadcast only behind a check of its size.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinfolk.functions.text import let
from kinfolk.runtime import sized_join, stored

#: Folders that hold foreign code, folders that hold dependencies, files that name a package, folders that
#: are generated.
VENDOR_DIRS = ("vendor", "third_party", "3rdparty", "thirdparty", "extern", "external")
CONTAINERS = ("crates", "libs", "deps", "dependencies", "packages")
MANIFESTS = ("Cargo.toml", "pyproject.toml", "package.json")
IGNORED = (".git", ".hg", ".svn", "build", "dist", "node_modules", "target")


def path_parts(path: Column) -> Column:
    """The parts of a path in lower case, with / for either slash; no empty parts, no single dots."""
    return F.filter(F.split(F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))


def identifier(name: Column) -> Column:
    """A package's name as an identifier."""
    return F.regexp_replace(F.lower(F.btrim(name)), r"[-.]", "_")


def _is_in(x: Column, values: tuple[str, ...]) -> Column:
    return x.isin(*values) if values else F.lit(False)


def vendored_name(parts: Column, vendor_dirs: tuple[str, ...]) -> Column:
    """The part after the first vendor folder that has one."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: _is_in(F.get(parts, i - 1), vendor_dirs) & (i < F.size(parts)))
    return F.get(parts, F.get(places, F.lit(0)))


def in_dependencies(parts: Column, at: Column, vendor_dirs: tuple[str, ...], containers: tuple[str, ...] = CONTAINERS) -> Column:
    """Whether the part at a place (from 0) stands where dependencies stand."""
    before = F.exists(F.slice(parts, F.lit(1), at), lambda x: _is_in(x, vendor_dirs + containers))
    return before | ((at == 0) & F.coalesce(F.get(parts, F.lit(1)) == "src", F.lit(False)))


@F.pandas_udf(StringType())
def _package_name(names: pd.Series, texts: pd.Series) -> pd.Series:
    def one(name: str, text: str | None) -> str | None:
        try:
            if name == "package.json":
                data = json.loads(text or "")
                found = data.get("name") if isinstance(data, dict) else None
            else:
                data = tomllib.loads(text or "")
                found = data.get("package", {}).get("name") if name == "Cargo.toml" else data.get("project", {}).get("name") or data.get("tool", {}).get("poetry", {}).get("name")
        except (ValueError, AttributeError):  # a manifest that cannot be read names no package
            return None
        return found if isinstance(found, str) else None

    return pd.Series([one(n, t) for n, t in zip(names, texts, strict=True)], dtype="object")


def _kept(path: Column) -> Column:
    return ~F.exists(path_parts(path), lambda x: _is_in(x, IGNORED))


def library_roots(files: DataFrame, registry: DataFrame) -> DataFrame:
    """repo, root, library: folders of packages (by manifest), and adapters of packages that the repository has.

    files: repo, path, text. registry: library, segments, integrations, imports (arrays). An adapter is a folder of a
    registered name some source of which imports the library; the name alone proves nothing.
    """
    files = files.filter(_kept(F.col("path")))
    names = registry.select("library", F.explode(F.array_union(F.array(identifier(F.col("library"))), F.array_union(F.transform("segments", identifier), F.transform("imports", identifier)))).alias("package"))
    names = stored(names.groupBy("package").agg(F.max("library").alias("library")), "package_names")
    base = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    manifests = files.withColumn("_base", base).filter(F.col("_base").isin(*MANIFESTS))
    found = manifests.select("repo", path_parts(F.col("path")).alias("_p"), identifier(_package_name("_base", "text")).alias("package"))
    packages = stored(sized_join(found, names, "package", "inner").select("repo", "library", F.array_join(F.slice("_p", F.lit(1), F.size("_p") - 1), "/").alias("root")), "packages")
    adapters = stored(registry.select("library", F.explode("integrations").alias("segment"), F.transform("imports", identifier).alias("imports")), "adapters")
    p = path_parts(F.col("path"))
    places = files.select("repo", "text", let(p, lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda s, i: F.struct(s.alias("segment"), F.array_join(F.slice(x, F.lit(1), i + 1), "/").alias("root")))).alias("_d"))
    # only sources under a folder of a registered name go on with their text
    under = sized_join(places.select("repo", "text", F.explode("_d").alias("d")).select("repo", "text", "d.segment", "d.root"), adapters, "segment", "inner")
    line = r"(?mi)^\s*(?:(?:pub\s+)?use|extern\s+crate|import|from)\s+([A-Za-z0-9_]+)"
    included = r"(?mi)^\s*#\s*include\s*[<\"]([A-Za-z0-9_]+)[/>\"]"
    used = F.transform(F.concat(F.regexp_extract_all("text", F.lit(line), 1), F.regexp_extract_all("text", F.lit(included), 1)), F.lower)
    imports = under.filter(F.arrays_overlap(used, F.col("imports"))).select("repo", "library", "root").distinct()
    return packages.filter("root <> ''").distinct().unionByName(imports.join(packages.select("repo", "library").distinct(), ["repo", "library"], "left_semi"))


def library_of(files: DataFrame, registry: DataFrame, roots: DataFrame | None = None, vendor_dirs: tuple[str, ...] = VENDOR_DIRS, containers: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """files (repo, path and others) with library and basis (root, vendor or segment); both null for the repository's own.

    registry: segment (lower case), library, needs_context; of two rows for a segment the last library by name counts.
    roots: see library_roots. A null path is no library.
    """
    parts = path_parts(F.col("path"))
    paths = stored(files.select("repo", "path").distinct().select("repo", "path", parts.alias("_p")), "paths")
    each = paths.select("repo", "path", "_p", F.posexplode("_p").alias("_at", "segment"))
    known = stored(registry.groupBy("segment").agg(F.max(F.struct("library", "needs_context")).alias("r")).select("segment", "r.*"), "library_registry")
    fits = ~F.col("needs_context") | in_dependencies(F.col("_p"), F.col("_at"), vendor_dirs, containers)
    by_name = sized_join(each, known, "segment", "inner").filter(fits).groupBy("repo", "path").agg(F.min_by("library", "_at").alias("_segment"))
    out = paths.withColumn("_vendor", vendored_name(F.col("_p"), vendor_dirs)).join(by_name, ["repo", "path"], "left")
    out = out.withColumn("_root", F.lit(None).cast("string"))
    if roots is not None:
        prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_p", F.lit(1), n), "/").alias("root")))
        asked = paths.filter(F.size("_p") > 0).select("repo", "path", F.explode(prefixes).alias("x")).select("repo", "path", "x.*")
        best = sized_join(asked, stored(roots, "library_roots"), ["repo", "root"], "inner").groupBy("repo", "path")
        out = out.drop("_root").join(best.agg(F.max_by("library", F.struct("n", "library")).alias("_root")), ["repo", "path"], "left")
    basis = F.when(F.col("_root").isNotNull(), "root").when(F.col("_vendor").isNotNull(), "vendor").when(F.col("_segment").isNotNull(), "segment")
    found = out.select("repo", "path", F.coalesce("_root", "_vendor", "_segment").alias("library"), basis.alias("basis"))
    return files.join(found, ["repo", "path"], "left")


def library_totals(tagged: DataFrame) -> DataFrame:
    """library, n_files, n_repos of the files that are a library's, the most files first."""
    return tagged.filter("library is not null").groupBy("library").agg(F.count("*").alias("n_files"), F.count_distinct("repo").alias("n_repos"))
