"""File-tree hygiene and organization over ``files(path, size_bytes[, git_tracked])``: narrow rules but for two groupings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.config import glob_regex
from prosemill.functions.text import canonical_stem

# Default rules.
IGNORED = ("vendor/**", "third_party/**", "node_modules/**", "**/*.min.*", "dist/**", "build/**", "**/.git/**", "target/**", "reports/**", "**/reports/**", "**/flow-proposal.md", "**/flow-audit.json", "**/node_modules/**", "**/dist/**", "**/build/**", "**/target/**", "**/out/**", "**/coverage/**", "**/.idea/**")
SLOP = ("**/*copy*", "**/*backup*", "**/*old*", "**/*new*", "**/*final*", "**/*(1)*", "**/*(2)*", "**/*-draft*")
BANNED_DIRS = ("__pycache__", ".pytest_cache", ".idea", ".vscode", ".DS_Store", "Thumbs.db")
SUSPICIOUS = (r"(?i)(copy|backup|old|new|final(_?final)?|final2|\(\d+\)|-draft|cleanup|helper|utils2|script_final)",)
LARGE = ("**/*.json", "**/*.yaml", "**/*.yml")
LARGE_ALLOWED = ("fixtures/**", "tests/fixtures/**", "data/raw/**")
ROOT_ALLOWED = ("readme.md", "contributing.md", "code_of_conduct.md", "security.md", "changelog.md", "agents.md")
ROOT_HINTS = ("claude", "chatgpt", "copilot", "ai", "agent", "changes", "diff", "output", "response", "analysis", "notes")
DATA_EXTENSIONS = ("csv", "xlsx", "xls", "json", "parquet", "sqlite", "db")
SCRIPT_EXTENSIONS = ("py", "sh", "bash", "ps1", "rb", "pl")
LEGACY = ("*_v[0-9]*", "*_old*", "*.bak", "*~", "*.orig", "*_backup*", "*_copy*", "Copy of *")
SCRIPT_DIRS = ("scripts", "bin", "tools", "utils", "scratch", "experiments", "analysis", "poc")
DATA_DIRS = ("data", "assets", "fixtures", "testdata", "public", "output", "outputs", "reports", "artifacts", "exports", "export")
OUTPUT_DIRS = ("output", "outputs", "out", "results", "artifacts", "generated", "exports", "export", "tmp", "temp")
EXPERIMENTS = ("test", "scratch", "temp", "debug", "poc", "experiment", "analysis")
PROSE = ("md", "markdown", "mdx", "txt", "rst")
CODE = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}
# End of fixed values.


@dataclass(frozen=True)
class RepoRules:
    ignore: tuple[str, ...] = IGNORED
    slop: tuple[str, ...] = SLOP
    banned_dirs: tuple[str, ...] = BANNED_DIRS
    suspicious: tuple[str, ...] = SUSPICIOUS
    large: tuple[str, ...] = LARGE
    large_allowed: tuple[str, ...] = LARGE_ALLOWED
    large_kb: int = 500
    locks: bool = True


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    return F.coalesce(*[F.when(extension(path) == e, F.lit(n)) for e, n in CODE.items()])


def matches(path: Column, globs) -> Column:
    return path.rlike("|".join(f"^(?:{glob_regex(g)})$" for g in globs)) if globs else F.lit(False)


def scanned(files: DataFrame, extensions=PROSE, ignore=(), max_kb: int | None = None) -> DataFrame:
    """Files that a scan takes: by extension, without ignored paths, up to a size."""
    out = files.filter(extension(F.col("path")).isin(*extensions) & ~matches(F.col("path"), ignore))
    return out if max_kb is None else out.filter(F.col("size_bytes") <= max_kb * 1024)


def issues(files: DataFrame, rules: RepoRules | None = None) -> DataFrame:
    """(category, path) of every rule.

    The rules on one path are one array, exploded in one pass; banned directories, lock files and
    duplicate variants are grouped by directory after that.
    """
    rules = rules or RepoRules()
    path, name = F.col("path"), file_name(F.col("path"))
    banned = F.array(*[F.lit(d.lower()) for d in rules.banned_dirs])
    dirs = F.split(F.lower(directory(path)), "/")
    first = F.array_position(F.transform(dirs, lambda d: F.array_contains(banned, d)), True)
    inside, lower = first > 0, F.lower(name)
    stray = ~path.contains("/") & lower.endswith(".md") & ~lower.isin(*ROOT_ALLOWED) & ~lower.startswith("license") & lower.rlike("|".join(ROOT_HINTS))
    tests = {
        "banned-file": F.array_contains(banned, lower),
        "slop": matches(path, rules.slop),
        "suspicious-name": reduce(Column.__or__, [name.rlike(p) for p in rules.suspicious]),
        "large-json": matches(path, rules.large) & ~matches(path, rules.large_allowed) & (F.col("size_bytes") > rules.large_kb * 1024),
        "stray-markdown": stray,
    }
    issue = lambda category, where: F.struct(F.lit(category).alias("category"), where.alias("path"))
    top = F.array_join(F.slice(F.split(path, "/"), F.lit(1), first.cast("int")), "/")
    found = F.when(inside, F.array(issue("banned-dir", top))).otherwise(F.filter(F.array(*[F.when(c, issue(k, path)) for k, c in tests.items()]), lambda x: x.isNotNull()))
    own = files.filter(~matches(path, rules.ignore))
    narrow = own.select(F.explode(found).alias("x")).select("x.*")
    dirs_once = narrow.filter("category = 'banned-dir'").distinct()
    out = [dirs_once, narrow.filter("category <> 'banned-dir'")]
    open_ = own.filter(~inside)
    if rules.locks:
        locks = open_.filter(name.isin("package-lock.json", "yarn.lock")).select(directory(path).alias("path"), name.alias("name"))
        out.append(locks.groupBy("path").agg(F.countDistinct("name").alias("n")).filter("n > 1").select(F.lit("lockfile").alias("category"), "path"))
    out.append(duplicate_variants(open_).select(F.lit("dup-variants").alias("category"), F.array_join("members", ", ").alias("path")))
    return reduce(DataFrame.unionByName, out)


def duplicate_variants(files: DataFrame) -> DataFrame:
    """(directory, canonical, members): files of one directory whose names differ by version words alone."""
    path = F.col("path")
    keyed = files.select("path", directory(path).alias("directory"), F.concat_ws(".", canonical_stem(stem(path)), F.when(extension(path) != "", extension(path))).alias("canonical"))
    return keyed.groupBy("directory", "canonical").agg(F.sort_array(F.collect_set("path")).alias("members")).filter(F.size("members") > 1)


def legacy(name: Column, patterns=LEGACY) -> Column:
    """Whether a file name looks like a leftover; a pattern without a star never matches."""
    tests = []
    for p in (x.lower() for x in patterns):
        if "[0-9]" in p:
            tests.append(F.lower(name).rlike("^" + p.replace("*", ".*") + "$"))
        elif p.startswith("*") and p.endswith("*"):
            tests.append(F.lower(name).contains(p[1:-1]))
        elif p.startswith("*"):
            tests.append(F.lower(name).endswith(p[1:]))
        elif p.endswith("*"):
            tests.append(F.lower(name).startswith(p[:-1]))
    return reduce(Column.__or__, tests, F.lit(False))


def output_prefix(path: Column) -> Column:
    """The path up to its first output directory, or null."""
    parts = F.split(directory(path), "/")
    at = F.array_position(F.transform(parts, lambda d: F.lower(d).isin(*OUTPUT_DIRS)), True)
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/"))


def organize(files: DataFrame, min_data_bytes: int = 100 * 1024) -> DataFrame:
    """(path, issue, action, target): the first rule that fits each file."""
    path = F.col("path")
    name, ext = file_name(path), extension(path)
    rooted = F.lower(F.concat(F.lit("/"), path))
    in_source = ~rooted.rlike("/(?:" + "|".join(SCRIPT_DIRS + DATA_DIRS) + ")/")
    tracked = F.coalesce("git_tracked", F.lit(True))
    in_scripts = F.concat(F.lit("/"), path).rlike("/(?:" + "|".join(SCRIPT_DIRS) + ")/")
    in_ui = path.contains("ui/") | path.contains("src/components")
    make = lambda issue, action, target: F.struct(F.lit(issue).alias("issue"), action.alias("action"), target.alias("target"))
    verdict = (
        F.when(~tracked & output_prefix(path).isNotNull(), make("untracked-experiment", F.lit("gitignore"), output_prefix(path)))
        .when(legacy(name), make("legacy", F.when(name.rlike(r"(?:\.bak|~|\.orig)$"), "delete").otherwise("archive"), F.concat(F.lit("archive/"), name)))
        .when(ext.isin(*DATA_EXTENSIONS) & (F.col("size_bytes") >= min_data_bytes) & in_source, make("data-in-source", F.lit("move"), F.concat(F.lit("data/"), name)))
        .when(ext.isin(*SCRIPT_EXTENSIONS) & in_ui & ~in_scripts, make("misplaced", F.lit("move"), F.concat(F.lit("scripts/"), name)))
        .when(~tracked & ext.isin(*SCRIPT_EXTENSIONS) & F.lower(name).rlike("|".join(EXPERIMENTS)), make("untracked-experiment", F.lit("move"), F.concat(F.lit("scratch/"), name)))
    )
    return files.withColumn("v", verdict).filter("v IS NOT NULL").select("path", "v.issue", "v.action", "v.target")


def organize_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("issue").agg(F.count("*").alias("n"))


def organize_prompt(found: DataFrame, limit: int = 10) -> DataFrame:
    """One text for each issue: up to ``limit`` files in order of path. Only those are gathered."""
    first = Window.partitionBy("issue").orderBy("path", "action", "target")
    shown = found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= limit)
    top = shown.groupBy("issue").agg(F.sort_array(F.collect_list(F.struct("path", "action", "target"))).alias("xs"))
    line = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- "), x["path"], F.lit(": "), x["action"], F.lit(" -> "), F.coalesce(x["target"], F.lit("")))), "\n")
    return top.select("issue", F.concat(F.lit("## "), "issue", F.lit("\n"), line).alias("prompt"))


def repo_type(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row: the kind of a repository and how sure that is, by marker files; later rules win."""
    has = lambda *names: F.max(F.col("path").isin(*names).cast("int")) == 1
    flags = files.agg(
        (has("package.json") & has("src/App.tsx", "src/App.jsx", "src/App.vue", "src/App.svelte")).alias("frontend"),
        has("pyproject.toml", "setup.py").alias("python"),
        (has("requirements.txt") & (F.max(F.col("path").rlike(r"^[^/]*(?:/[^/]*)?\.ipynb$").cast("int")) == 1)).alias("notebooks"),
        has("pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json").alias("monorepo"),
        has("Cargo.toml").alias("cargo"),
    )
    if manifest is not None:
        work = manifest.filter((F.col("path") == "Cargo.toml") & F.col("text").contains("[workspace]")).limit(1).agg(F.count("*").alias("n"))
        flags = flags.join(F.broadcast(work), F.lit(True)).withColumn("cargo", F.col("cargo") & (F.col("n") > 0))
    kind = F.when(F.col("cargo"), "rust-workspace").when(F.col("monorepo"), "monorepo").when(F.col("frontend"), "frontend").when(F.col("python") | F.col("notebooks"), "python").otherwise("mixed")
    sure = F.when(F.col("cargo") | F.col("monorepo"), 0.95).when(F.col("frontend"), 0.9).when(F.col("python"), 0.85).when(F.col("notebooks"), 0.8).otherwise(0.3)
    return flags.select(kind.alias("kind"), sure.alias("confidence"))
