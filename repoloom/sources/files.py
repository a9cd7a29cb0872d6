"""Repository files as a table: (repo, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from repoloom.functions.paths import basename, glob_regex, segments
from repoloom.functions.running import ranks
from repoloom.functions.text import lines, line_count

# Manifest files with ecosystem, precedence and pattern position.
MANIFESTS = [
    ("go.mod", "go", 0, 0),
    ("pyproject.toml", "python", 1, 0),
    ("setup.py", "python", 1, 1),
    ("package.json", "typescript", 2, 0),
    ("Cargo.toml", "rust", 3, 0),
    ("foundry.toml", "solidity", 4, 0),
    ("hardhat.config.ts", "solidity", 4, 1),
    ("hardhat.config.js", "solidity", 4, 2),
    ("Package.swift", "swift", 5, 0),
]
# Excluded folders per ecosystem.
EXCLUDES = {
    "go": ["**/vendor/**", "**/testdata/**", "**/.git/**"],
    "python": [
        "**/venv/**", "**/.venv/**", "**/env/**", "**/__pycache__/**", "**/.git/**",
        "**/node_modules/**", "**/.tox/**", "**/.eggs/**",
    ],
    "typescript": [
        "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.nuxt/**",
    ],
    "rust": ["**/target/**", "**/.git/**"],
    "solidity": [
        "**/node_modules/**", "**/.git/**", "**/out/**", "**/cache/**", "**/artifacts/**",
        "**/typechain/**", "**/typechain-types/**", "**/lib/forge-std/**", "**/lib/openzeppelin-*/**",
        "**/lib/eigenlayer-*/**", "**/lib/ds-test/**", "**/lib/zeus-*/**",
    ],
    "swift": ["**/.build/**", "**/.git/**", "**/Pods/**", "**/Carthage/**", "**/DerivedData/**"],
}


def scan_repos(spark: SparkSession, root: str, path_glob: str | None = None) -> DataFrame:
    """Files below ``root/<repo>/`` as (repo, path, content, size_bytes).

    Contents are decoded as UTF-8; undecodable bytes become the replacement
    character. ``path_glob`` filters on file names before any content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    base = root.rstrip("/")
    rel = F.substring_index("path", base + "/", -1)
    return reader.load(base).select(
        F.substring_index(rel, "/", 1).alias("repo"),
        F.regexp_replace(rel, "^[^/]*/", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size_bytes"),
    )


def excluded(path: Column, patterns: list[str], mode: str = "segment") -> Column:
    """Does ``path`` lie in an excluded folder?

    ``segment`` compares whole folder names (``*`` matches inside one);
    ``substring`` looks for the bare text of the pattern anywhere in the path.
    """
    if mode not in ("segment", "substring"):
        raise ValueError(f"unknown mode {mode!r}")
    out = F.lit(False)
    for pattern in patterns:
        bare = pattern.removeprefix("**/").removesuffix("/**")
        if mode == "substring":
            out = out | F.contains(path, F.lit(bare))
        else:
            out = out | F.rlike(path, F.lit("(?:^|/)" + glob_regex(bare)[1:-1] + "/"))
    return out


def exclude_paths(files: DataFrame, ecosystem: str, mode: str = "segment") -> DataFrame:
    return files.filter(~excluded(F.col("path"), EXCLUDES[ecosystem], mode))


def match_manifests(files: DataFrame) -> DataFrame:
    """Files that are manifests, with (ecosystem, precedence, pattern)."""
    found = F.lit(None)
    base = basename(F.col("path"))
    for name, eco, precedence, pattern in reversed(MANIFESTS):
        row = F.struct(
            F.lit(eco).alias("ecosystem"), F.lit(precedence).alias("precedence"), F.lit(pattern).alias("pattern")
        )
        found = F.when(base == name, row).otherwise(found)
    return files.withColumn("_m", found).filter("_m is not null").select(*files.columns, "_m.*")


def glob_files(files: DataFrame, pattern: str, prefix: str | None = None, cap: int | None = None) -> DataFrame:
    """Matching paths per repo with their place in path order: (repo, path, pos).

    ``cap`` keeps the first ones; :func:`glob_overflow` counts what it leaves out.
    """
    hit = _globbed(files, pattern, prefix).withColumn("_parts", segments(F.col("path")))
    return ranks(hit, ["repo"], ["_parts"], cap).drop("_parts")


def glob_overflow(files: DataFrame, pattern: str, prefix: str | None = None, cap: int = 500) -> DataFrame:
    """(repo, matches, more): counted without sorting."""
    counts = _globbed(files, pattern, prefix).groupBy("repo").agg(F.count("*").alias("matches"))
    return counts.select("repo", "matches", F.greatest(F.col("matches") - cap, F.lit(0)).alias("more"))


def _globbed(files: DataFrame, pattern: str, prefix: str | None) -> DataFrame:
    if prefix:
        files = files.filter(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
        rel = F.substr("path", F.lit(len(prefix.rstrip("/")) + 2))
    else:
        rel = F.col("path")
    return files.filter(F.rlike(rel, F.lit(glob_regex(pattern)))).select("repo", "path")


def exclude_vendored(files: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Drop ``candidates`` (default: all files) below ``<p>/lib/`` where
    ``<p>/foundry.toml`` exists. Only paths with a ``lib`` folder are exploded."""
    rows = files if candidates is None else candidates
    owners = files.filter(basename(F.col("path")) == "foundry.toml").select(
        "repo", F.regexp_replace("path", "/?[^/]*$", "").alias("_owner")
    )
    parts = segments(F.col("path"))
    libs = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i) == "lib")
    parents = F.transform(libs, lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    # a top-level lib/ counts like any other: its project root is the repository
    below = rows.filter(F.rlike("path", F.lit("(?:^|/)lib/"))).select("repo", "path", F.explode(parents).alias("_owner"))
    vendored = below.join(owners, ["repo", "_owner"], "left_semi").select("repo", "path").distinct()
    return rows.join(vendored, ["repo", "path"], "left_anti")


def read_lines(files: DataFrame, offset: int = 1, limit: int | None = None, max_line: int | None = None) -> DataFrame:
    """Numbered lines [offset, offset + limit) of every file; without ``limit`` up to the end.

    (repo, path, line_no, line, total_lines, note). Lines over ``max_line`` characters
    are shortened as a viewer would; ``note`` is set when lines follow the window.
    """
    total = line_count(F.col("content"))
    last = 2**31 - 1 if limit is None else offset - 1 + limit
    window = F.slice(lines(F.col("content")), offset, last - offset + 1)
    line = F.col("_l")
    if max_line is not None:
        line = F.when(F.length("_l") > max_line, F.concat(F.substring("_l", 1, max_line), F.lit("... (truncated)"))).otherwise(line)
    note = F.when(
        total > last,
        F.concat(F.lit(f"(Showing lines {offset}-{last} of "), total.cast("string"), F.lit(" total lines)")),
    )
    rows = files.select("repo", "path", total.alias("total_lines"), note.alias("note"), F.posexplode(window).alias("_i", "_l"))
    return rows.select(
        "repo", "path", (F.col("_i") + offset).alias("line_no"),
        line.alias("line"),
        "total_lines", "note",
    )


def matching_lines(files: DataFrame, pattern: str, include: str | None = None) -> DataFrame:
    """(repo, path, line_no, line) of all lines matching a Java regex."""
    some = files
    if include:
        tail = F.col("path") if "/" in include else basename(F.col("path"))
        some = some.filter(F.rlike(tail, F.lit(glob_regex(include))))
    rows = some.filter(F.rlike("content", F.lit("(?m)" + pattern))).select(
        "repo", "path", F.posexplode(lines(F.col("content"))).alias("_i", "line")
    )
    return rows.filter(F.rlike("line", F.lit(pattern))).select("repo", "path", (F.col("_i") + 1).alias("line_no"), "line")


def grep(files: DataFrame, pattern: str, include: str | None = None, cap: int | None = None) -> DataFrame:
    """All matching lines, to be sorted by path and line; with ``cap`` the first ones per repo in that order."""
    hits = matching_lines(files, pattern, include)
    if cap is None:
        return hits
    order = Window.partitionBy("repo").orderBy(segments(F.col("path")), "line_no")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def grep_overflow(files: DataFrame, pattern: str, include: str | None = None, cap: int = 500) -> DataFrame:
    counts = matching_lines(files, pattern, include).groupBy("repo").agg(F.count("*").alias("matches"))
    return counts.select("repo", "matches", F.greatest(F.col("matches") - cap, F.lit(0)).alias("more"))
