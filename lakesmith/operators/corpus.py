"""Source-corpus profiles: a table of files ``(path, content,
size)``, e.g. from ``spark.read.format("binaryFile")`` or
``wholetext``, one row per file. Everything is a column expression or a
``groupBy``; no file is read on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories skipped when walking a repository.
IGNORE_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache",
               ".pytest_cache", "dist", "build", ".next", ".nuxt", "target", "bin", "obj", ".idea",
               ".vscode", ".eggs", "vendor", "bower_components", ".terraform", ".gradle"]
# File extension -> language.
LANG_MAP = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript (React)",
    ".jsx": "JavaScript (React)", ".java": "Java", ".kt": "Kotlin", ".go": "Go",
    ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".cpp": "C++",
    ".c": "C", ".h": "C/C++ Header", ".swift": "Swift", ".scala": "Scala",
    ".r": "R", ".lua": "Lua", ".sh": "Shell", ".bash": "Shell",
    ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".scss": "SCSS",
    ".vue": "Vue", ".svelte": "Svelte", ".dart": "Dart", ".ex": "Elixir",
    ".exs": "Elixir", ".zig": "Zig", ".nim": "Nim", ".jl": "Julia",
}
# Name fragments that mark important files, and entry points.
PRIORITY_NAMES = ["main", "app", "index", "server", "routes", "models", "views", "controllers",
                  "api", "config", "settings", "schema", "database", "db", "auth", "login",
                  "handler", "middleware", "utils", "helpers", "service", "manager"]
ENTRY_POINTS = ["main", "app", "index", "server", "manage"]
# File roles by ordered name patterns (first match wins).
ROLE_PATTERNS = [
    ("Testing", r"(test|spec)"),
    ("Entry Point", None),
    ("Routing", r"(route|url|endpoint|api)"),
    ("Data Model", r"(model|schema|entity)"),
    ("Presentation", r"(view|template|page|component)"),
    ("Business Logic", r"(controller|handler|service)"),
    ("Configuration", r"(config|settings|env)"),
    ("Utility", r"(util|helper|common|shared)"),
    ("Database", r"(db|database|connect|migration)"),
    ("Authentication", r"(auth|login|signup|session|token)"),
    ("Middleware", r"(middleware|interceptor|filter)"),
]
# Symbol patterns per language (group 1 is the name).
SYMBOL_PATTERNS = {
    "Python": (r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", r"(?m)^\s*class\s+(\w+)\s*[\(:]"),
    "JavaScript": (r"(?m)(?:^|\s)(?:async\s+)?function\s+(\w+)", r"(?m)^\s*class\s+(\w+)"),
    "TypeScript": (r"(?m)(?:^|\s)(?:export\s+)?(?:async\s+)?function\s+(\w+)",
                   r"(?m)^\s*(?:export\s+)?class\s+(\w+)"),
    "Go": (r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r"(?m)^type\s+(\w+)\s+struct"),
}
TEST_NAME = r"(?i)(^test_|_test\.py$|\.test\.(js|ts|jsx|tsx)$|\.spec\.(js|ts|jsx|tsx)$|Test\.java$|_test\.go$|_spec\.rb$)"


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+", ""), "/")


def file_name(path: Column) -> Column:
    return F.element_at(_parts(path), -1)


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    m = F.create_map(*[x for k, v in LANG_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, extension(path))


def not_ignored(path: Column) -> Column:
    dirs = F.slice(_parts(path), 1, F.greatest(F.size(_parts(path)) - 1, F.lit(0)))
    return ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORE_DIRS]))


def language_counts(files: DataFrame, path: str = "path", top: int = 15) -> DataFrame:
    """COR-01: files per language (known extensions, ignored dirs removed),
    top 15 by count then name."""
    p = F.col(path)
    return (files.where(not_ignored(p)).select(language(p).alias("language")).where("language is not null")
            .groupBy("language").count().orderBy(F.desc("count"), F.asc("language")).limit(top))


def file_score(path: Column) -> Column:
    """COR-02 importance score."""
    s = stem(path)
    depth = F.size(_parts(path))
    prio = F.lit(False)
    for n in PRIORITY_NAMES:
        prio = prio | s.contains(n)
    return (F.when(prio, 10).otherwise(0) + F.when(s.isin(*ENTRY_POINTS), 20).otherwise(0)
            + F.when(depth <= 2, 5).otherwise(0) + F.when(depth == 1, 10).otherwise(0)
            + F.when(F.array_contains(_parts(path), "src"), 5).otherwise(0)
            - F.when(s.rlike("(?i)(test|spec|__test__|_test)"), 15).otherwise(0))


def rank_files(files: DataFrame, path: str = "path", size: str = "size", top: int = 30,
               max_bytes: int = 16000) -> DataFrame:
    """COR-02: source files (known source extension, not ignored, size at
    most ``max_bytes``) by score desc, path asc; top 30."""
    p = F.col(path)
    src = extension(p).isin(*[k for k in LANG_MAP if k not in (".html", ".css", ".scss")])
    return (files.where(not_ignored(p) & src & (F.col(size) <= max_bytes))
            .select(path, size, file_score(p).alias("score"))
            .orderBy(F.desc("score"), F.asc(path)).limit(top))


def file_role(path: Column) -> Column:
    """COR-03: first matching role of the file stem, else Source."""
    s = stem(path)
    e = None
    for role, pat in ROLE_PATTERNS:
        cond = s.isin(*ENTRY_POINTS) if pat is None else s.rlike("(?i)" + pat)
        e = F.when(cond, role) if e is None else e.when(cond, role)
    return e.otherwise("Source")


def classify_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("role", file_role(F.col(path)))


def corpus_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """COR-04: per file language, lines, functions and classes (names not
    starting with ``_``; control words excluded), test files split off by
    name; totals per language and the primary language (most lines)."""
    p = F.col(path)
    lang = language(p)
    is_test = file_name(p).rlike(TEST_NAME) | p.rlike("/(test|tests|__tests__)/")
    f = files.where(not_ignored(p) & lang.isNotNull()).select(
        path, lang.alias("language"), is_test.alias("is_test"),
        (F.size(F.split(F.col(content), "\n"))).alias("lines"), content)
    fn_e, cl_e = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for lg, (fp, cp) in SYMBOL_PATTERNS.items():
        fn_e = F.when(F.col("language").startswith(lg), F.regexp_extract_all(content, F.lit(fp), 1)).otherwise(fn_e)
        cl_e = F.when(F.col("language").startswith(lg), F.regexp_extract_all(content, F.lit(cp), 1)).otherwise(cl_e)
    ctl = F.array(*[F.lit(w) for w in ("if", "for", "while", "switch", "return")])
    out = (f.withColumn("functions", F.filter(F.coalesce(fn_e, F.array().cast("array<string>")),
                                              lambda n: ~n.startswith("_") & ~F.array_contains(ctl, n)))
           .withColumn("classes", F.coalesce(cl_e, F.array().cast("array<string>")))
           .drop(content))
    return out


def corpus_totals(symbols: DataFrame) -> DataFrame:
    src = symbols.where(~F.col("is_test"))
    per = src.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"),
                                      F.sum(F.size("functions")).alias("functions"),
                                      F.sum(F.size("classes")).alias("classes"))
    tests = symbols.where("is_test").agg(F.count(F.lit(1)).alias("test_files"))
    prim = per.orderBy(F.desc("lines"), F.asc("language")).limit(1).select(F.col("language").alias("primary_language"))
    return per.crossJoin(tests).crossJoin(prim)     # two single-row frames


def tree_sizes(files: DataFrame, path: str = "path", size: str = "size", max_depth: int = 4) -> DataFrame:
    """COR-05: one row per directory (depth <= max_depth) with the number of
    files below it, at any depth, and their bytes."""
    p = F.col(path)
    parts = _parts(p)
    f = (files.where(not_ignored(p)).select(parts.alias("parts"), F.col(size).alias("sz"))
         .where(F.size("parts") > 1))
    upto = F.least(F.size("parts") - 1, F.lit(max_depth))
    dirs = f.select(F.explode(F.transform(F.sequence(F.lit(1), upto),
                                          lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("dir"), "sz")
    return dirs.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("sz").alias("bytes")) \
        .withColumn("depth", F.size(F.split("dir", "/")))
