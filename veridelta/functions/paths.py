"""Functions of paths and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File endings of source languages.
SOURCE = ("go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "java", "kt", "kts", "cs", "c", "h", "cpp", "hpp", "rb", "php", "swift", "sql", "sh")
#: Names of dependency manifests and lock files.
MANIFESTS = (
    "go.mod", "go.sum", "go.work", "go.work.sum", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "cargo.toml", "cargo.lock", "requirements.txt",
    "pyproject.toml", "poetry.lock", "uv.lock", "pipfile", "pipfile.lock", "gemfile", "gemfile.lock", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "composer.lock",
)
#: The language of a file ending.
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust"}


def glob_regex(glob: str) -> str:
    """An anchored pattern of a relative glob: ``**/`` is any folders, ``**`` anything, ``*`` and ``?`` stay within one name."""
    if not glob or glob.startswith("/") or "\\" in glob or "\0" in glob:
        raise ValueError(f"not a relative glob: {glob!r}")
    parts = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(p) or re.sub(r"([^\w/\-])", r"\\\1", p) for p in parts) + "$"


def first_glob(path: Column, globs: list[str]) -> Column:
    """The first of ``globs`` that matches a path, or null."""
    return F.coalesce(*(F.when(path.rlike(glob_regex(g)), F.lit(g)) for g in globs))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The ending of the last name, in lower case, without its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE)


def is_manifest(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*MANIFESTS) | path.endswith(".csproj")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    base = base_name(low)
    return base.rlike(r"(_test\.go|_test\.py|test\.java)$|\.(test|spec)\.|^test_") | F.concat(F.lit("/"), low).rlike("/(tests|__tests__)/")


def is_low_noise(path: Column) -> Column:
    """Whether samples are expected in a file: documentation, licenses, tests."""
    low = F.lower(path)
    return extension(path).isin("md", "rst", "txt", "adoc", "html") | base_name(low).rlike("^(license|notice|authors|codeowners)") | is_test(path) | F.concat(F.lit("/"), low).rlike("/(testdata|fixtures)/")


def is_documentation(path: Column) -> Column:
    """Whether a file is prose, where settings are quoted rather than made."""
    return extension(path).isin("md", "rst", "adoc")


def language(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path)), F.lit(""))


def test_stem(path: Column) -> Column:
    """The name of what a test file tests."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), r"(_test|\.test|\.spec)$", ""), "^test_", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(F.when(F.contains(path, F.lit("/")), path).otherwise(F.lit("./x")), "/[^/]*$", "")


def matching(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, glob) of every match. ``globs`` are a policy: a few rows, read to the driver up to 1,000 and turned into one expression, so paths stay where they are."""
    rows = [r["glob"] for r in globs.select("glob").distinct().orderBy("glob").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("more than 1000 globs")
    hits = F.filter(F.array(*(F.when(F.col("path").rlike(glob_regex(g)), F.lit(g)) for g in rows)), lambda g: g.isNotNull())
    return paths.select("path", F.explode(hits).alias("glob"))
