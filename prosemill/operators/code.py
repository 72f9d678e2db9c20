"""Source text: dependency edges, token shapes, duplicates, comments, placeholders and coverage.

What regular expressions say exactly is Columns; Python sources are parsed by the standard
library's ``ast`` in one Arrow pass. There is no parser for other languages here, so graphs of
theirs are input tables.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import lines
from prosemill.operators.repo import directory, extension, language
from prosemill.session import ship

# Keywords that keep their spelling, comment marks.
KEYWORDS = [
    "as", "async", "await", "break", "const", "continue", "crate", "dyn", "else", "enum", "extern", "false", "fn",
    "for", "if", "impl", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref", "return", "self", "Self",
    "static", "struct", "super", "trait", "true", "type", "unsafe", "use", "where", "case", "catch", "class",
    "default", "export", "extends", "finally", "from", "function", "get", "import", "interface", "implements", "new",
    "null", "private", "protected", "public", "set", "switch", "this", "throw", "try", "undefined", "var", "and",
    "def", "elif", "except", "False", "is", "lambda", "None", "not", "or", "pass", "raise", "True", "with", "yield",
]
SLASHED = ("rs", "ts", "tsx", "js", "jsx", "java", "go", "c", "h", "cpp", "hpp", "cs", "swift", "kt", "php")
HASHED = ("py", "rb", "sh", "bash", "toml", "yaml", "yml")
JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
# End of fixed values.
_EDGE = "array<struct<line:int,kind:string,to_raw:string>>"


def numbered_lines(files: DataFrame, *keep: str) -> DataFrame:
    return files.select("path", *keep, F.posexplode(lines(F.col("text"))).alias("i", "line")).withColumn("line_no", F.col("i") + 1).drop("i")


def raw_edges(files: DataFrame) -> DataFrame:
    """(from, line, kind, to_raw) of relative imports, requires, Python relative imports and Rust modules."""
    q = r"""['"]([^'"]+)['"]"""
    x = F.col("line")
    first = F.coalesce(*[F.when(x.rlike(p), F.regexp_extract(x, p, 1)) for p in (rf"^\s*import\s+(?:type\s+)?[^;]*?\s+from\s+{q}", rf"^\s*import\s+{q}", rf"^\s*export\s+[^;]*?\s+from\s+{q}")])
    js = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(x, F.lit(rf"require\(\s*{q}\s*\)"), 1), F.regexp_extract_all(x, F.lit(rf"import\(\s*{q}\s*\)"), 1))
    dotted = r"^\s*from\s+([.]+[A-Za-z0-9_.]*)\s+import\s+"
    py = F.when(x.rlike(dotted), F.array(F.regexp_extract(x, dotted, 1))).otherwise(F.array().cast("array<string>"))
    mod = r"^\s*(?:pub\s+)?mod\s+([A-Za-z0-9_]+)\s*;\s*$"
    rs = F.when(x.rlike(mod), F.array(F.concat(F.lit("mod "), F.regexp_extract(x, mod, 1)))).otherwise(F.array().cast("array<string>"))
    lang = language(F.col("path"))
    found = F.when(lang.isin("typescript", "javascript"), F.filter(js, lambda m: m.startswith("."))).when(lang == "python", py).when(lang == "rust", rs)
    out = numbered_lines(files).select(F.col("path").alias("from"), F.col("line_no").alias("line"), F.when(lang == "rust", "mod").otherwise("import").alias("kind"), F.explode(found).alias("to_raw"))
    return out.unionByName(rust_uses(files))


def rust_uses(files: DataFrame) -> DataFrame:
    """(from, line, kind, to_raw) of ``use`` statements, one level of braces opened, ``as`` names dropped."""
    own = files.filter(language(F.col("path")) == "rust")
    statement = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"
    hit = own.select(F.col("path").alias("from"), "text", F.posexplode(F.regexp_extract_all("text", F.lit(statement), 1)).alias("k", "body"))
    before = F.array_join(F.slice(F.split("text", statement, -1), F.lit(1), F.col("k") + 1), "")
    body = F.regexp_replace(F.regexp_replace("body", r"\s+", " "), r"\s+as\s+\w+", "")
    head, inner = F.regexp_extract(body, r"^([^{]*)\{", 1), F.regexp_extract(body, r"\{(.*)\}", 1)
    # commas outside inner braces
    parts = F.transform(F.split(inner, r",(?![^{]*\})"), lambda p: F.trim(p))
    targets = F.when(body.contains("{"), F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.when(p == "self", F.regexp_replace(head, "::$", "")).otherwise(F.concat(head, p)))).otherwise(F.array(F.trim(body)))
    line = F.size(F.split(before, "\n", -1)) + F.aggregate(F.slice(F.regexp_extract_all("text", F.lit(statement), 0), F.lit(1), F.col("k")), F.lit(0), lambda a, m: a + F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit(""))))
    return hit.select("from", line.alias("line"), F.lit("use").alias("kind"), F.explode(targets).alias("to_raw"))


def normalized_path(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` parts; null if it climbs out."""
    zero = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.struct(F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))).otherwise(F.struct(F.array_append(a["p"], x).alias("p"), a["ok"].alias("ok")))
    return F.aggregate(F.split(path, "/"), zero, step, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def resolve_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with ``to``: the first candidate path that is a file. Candidates are joined, not probed."""
    base = F.when(directory(F.col("from")) == "", F.lit("")).otherwise(F.concat(directory(F.col("from")), F.lit("/")))
    raw, lang = F.col("to_raw"), language(F.col("from"))
    target = F.concat(base, raw)
    js = F.concat(F.when(F.regexp_extract(raw, r"[^/.](\.[^./]+)$", 1) != "", F.array(target)).otherwise(F.array(*[F.concat(target, F.lit(f".{e}")) for e in JS_EXTENSIONS])), F.array(*[F.concat(target, F.lit(f"/index.{e}")) for e in JS_EXTENSIONS]))
    dots, rest = F.length(F.regexp_extract(raw, r"^(\.*)", 1)), F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    stem = F.concat(base, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    py = F.when(rest == "", F.array(F.concat(stem, F.lit("__init__.py")))).otherwise(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))))
    name = F.regexp_extract(raw, r"^mod (\w+)$", 1)
    rs = F.when(name != "", F.array(F.concat(base, name, F.lit(".rs")), F.concat(base, name, F.lit("/mod.rs"))))
    tries = F.when(lang.isin("typescript", "javascript"), js).when(lang == "python", py).when(lang == "rust", rs)
    keyed = edges.withColumn("edge", F.xxhash64("from", "line", "kind", "to_raw"))
    options = keyed.select("edge", F.posexplode(tries).alias("k", "option")).select("edge", "k", normalized_path(F.col("option")).alias("path")).filter("path IS NOT NULL")
    best = options.join(files.select("path").distinct(), "path").groupBy("edge").agg(F.min_by("path", "k").alias("to"))
    return keyed.join(best, "edge", "left").drop("edge").withColumn("resolved", F.col("to").isNotNull())


def crate_uses(edges: DataFrame, files: DataFrame, crates: DataFrame) -> DataFrame:
    """Rust ``use`` edges resolved: the longest module prefix that is a file of the crate named, else its root.

    ``crates`` (name, root, src): a crate's name, root file and source folder, also as ``crate`` for files below it.
    """
    edge = ["from", "line", "to_raw"]
    uses = edges.filter("kind = 'use'")
    parts = F.split("to_raw", "::")
    own = uses.select(*edge).distinct().withColumn("head", F.get(parts, 0)).withColumn("rest", F.slice(parts, F.lit(2), F.size(parts)))
    named = own.filter(~F.col("head").isin("crate", "self", "super")).join(crates, F.col("head") == F.col("name"))
    # the folders above a file are the source folders that it can stand in
    folders = F.split("from", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))), lambda k: F.array_join(F.slice(folders, F.lit(1), k), "/"))
    inner = own.filter("head = 'crate'").withColumn("folder", F.explode(above)).join(crates, F.col("folder") == F.col("src")).drop("folder")
    both = named.unionByName(inner)
    options = both.select(*edge, "src", "root", "rest", F.explode(F.sequence(F.lit(0), F.size("rest"))).alias("n"))
    module = F.array_join(F.slice("rest", F.lit(1), F.col("n")), "/")
    options = options.select(*edge, "n", F.explode(F.when(F.col("n") == 0, F.array("root")).otherwise(F.array(F.concat_ws("/", "src", F.concat(module, F.lit(".rs"))), F.concat_ws("/", "src", module, F.lit("mod.rs"))))).alias("path"))
    best = options.join(files.select("path").distinct(), "path").groupBy(*edge).agg(F.max_by("path", "n").alias("to"))
    return uses.drop("to", "resolved").join(best, edge, "left").withColumn("resolved", F.col("to").isNotNull())


def nodes(files: DataFrame) -> DataFrame:
    """(path, language, size_bytes, lines) of code files; an empty file has one line."""
    return files.filter(language(F.col("path")).isNotNull()).select("path", language(F.col("path")).alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), F.when(F.octet_length("text") == 0, 1).otherwise(F.size(lines(F.col("text")))).alias("lines"))


TOKEN = r""""[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|::|->|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|<<|>>|[^\sA-Za-z0-9_$"']"""


def token_shape(code: Column) -> Column:
    """(text, tokens): code without comments, strings and numbers blanked, names that are no keywords as ``id``."""
    bare = F.regexp_replace(code, r"(?s)/\*.*?\*/|//[^\n]*|(?m)^\s*#[^\n]*", " ")
    kinds = F.transform(F.regexp_extract_all(bare, F.lit(TOKEN), 0), lambda t: F.when(t.rlike("^[\"']"), '""').when(t.rlike("^[0-9]"), "0").when(t.rlike("^[A-Za-z_$]") & ~t.isin(*KEYWORDS), "id").otherwise(t))
    return F.struct(F.array_join(kinds, " ").alias("text"), F.size(kinds).alias("tokens"))


def duplicates(functions: DataFrame, min_tokens: int = 80, min_instances: int = 3, top: int = 20) -> DataFrame:
    """(language, tokens, n, path, line, evidence) of function bodies with one token shape.

    ``functions`` (language, path, line, symbol, text). Shapes are grouped by their text; the evidence
    of a group is its first 12, picked by a window whose sort spills, so no group is gathered whole.
    """
    shaped = functions.withColumn("shape", token_shape(F.col("text"))).select("language", "path", "line", "symbol", F.sha2("shape.text", 256).alias("shape"), F.col("shape.tokens").alias("tokens")).filter(F.col("tokens") >= min_tokens)
    groups = shaped.groupBy("language", "shape").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"), F.min(F.struct("path", "line")).alias("first")).filter(F.col("n") >= min_instances)
    best = groups.orderBy(F.desc("n"), "language", "shape").limit(top)
    order = Window.partitionBy("language", "shape").orderBy("path", "line")
    shown = shaped.join(F.broadcast(best.select("language", "shape")), ["language", "shape"]).withColumn("k", F.row_number().over(order)).filter("k <= 12")
    evidence = shown.groupBy("language", "shape").agg(F.sort_array(F.collect_list(F.struct("k", F.concat("path", F.lit(":"), "line", F.lit(" ("), "symbol", F.lit(")")).alias("s")))).alias("e"))
    listed = F.concat(F.transform("e", lambda x: x["s"]), F.when(F.col("n") > 12, F.array(F.concat(F.lit("... and "), F.col("n") - 12, F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    return best.join(evidence, ["language", "shape"]).select("language", "tokens", "n", F.col("first.path").alias("path"), F.col("first.line").alias("line"), listed.alias("evidence"))


def audit_summary(found: DataFrame) -> DataFrame:
    """Counts by category and by language in one pass."""
    both = found.groupingSets([["category"], ["language"]], "category", "language").agg(F.count("*").alias("n"), F.grouping("category").alias("g"))
    return both.select(F.when(F.col("g") == 0, "category").otherwise("language").alias("by"), F.coalesce("category", "language").alias("key"), "n")


def lonely(definitions: DataFrame, implementations: DataFrame, only_one: bool = False) -> DataFrame:
    """Abstractions with one implementation or none (``only_one``: exactly one); allowed ones are exempt."""
    counts = implementations.groupBy("name").agg(F.count("*").alias("n"))
    joined = definitions.filter("NOT allowed").join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.filter("n = 1" if only_one else "n <= 1").withColumn("action", F.when(F.col("n") == 0, "remove").otherwise("inline"))


def placeholders(files: DataFrame) -> DataFrame:
    """(path, line, severity) of unfinished code in Rust and in thrown errors of scripts."""
    x, lang = F.col("line"), language(F.col("path"))
    severity = (
        F.when((lang == "rust") & x.rlike(r"\b(?:todo|unimplemented)!"), "error")
        .when((lang == "rust") & x.rlike(r"(?i)\b(?:panic|unreachable)!.*todo"), "warning")
        .when(lang.isin("typescript", "javascript") & x.rlike(r"(?i)\bthrow\b.*(?:todo|not implemented)"), "warning")
        .when((lang == "python") & x.rlike(r"^\s*(?:pass|\.\.\.)\s*$|^\s*raise\s+NotImplementedError|(?i)^\s*raise\b.*todo"), "warning")
    )
    return numbered_lines(files).withColumn("severity", severity).filter("severity IS NOT NULL").select("path", F.col("line_no").alias("line"), "severity")


def comment_lines(files: DataFrame) -> DataFrame:
    """(path, total, comments, ratio): lines that are not blank, and those of them that are comments."""
    ext = extension(F.col("path"))
    opens, block = F.when(ext.isin(*HASHED), "#").when(ext == "sql", "--").otherwise("//"), ~ext.isin(*HASHED)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("comments"), F.lit(False).alias("inside"))
    step = lambda a, x: F.struct((a["total"] + 1).alias("total"), (a["comments"] + F.when(a["inside"] | x.startswith(F.col("opens")) | (F.col("block") & x.startswith("/*")), 1).otherwise(0)).alias("comments"), F.when(a["inside"], ~x.contains("*/")).otherwise(F.col("block") & ~x.startswith(F.col("opens")) & x.startswith("/*") & ~x.contains("*/")).alias("inside"))
    own = files.filter(ext.isin(*SLASHED, *HASHED, "sql")).withColumn("opens", opens).withColumn("block", block)
    kept = F.filter(F.transform(lines(F.col("text")), lambda s: F.trim(F.translate(s, "\t\r", "  "))), lambda s: s != "")
    out = own.withColumn("c", F.aggregate(kept, zero, step)).select("path", F.col("c.total").alias("total"), F.col("c.comments").alias("comments"))
    return out.filter("total > 0").withColumn("ratio", F.col("comments") / F.col("total"))


def stripped(files: DataFrame) -> DataFrame:
    """(path, text): full-line comments removed, in syntaxes without block comments."""
    own = files.filter(extension(F.col("path")).isin(*HASHED))
    kept = F.filter(F.split("text", "\n", -1), lambda s: ~F.ltrim(s).startswith("#"))
    return own.select("path", F.array_join(kept, "\n").alias("text"))


def coverage_format(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.endswith(".info") | name.contains("lcov"), "lcov").when(name.endswith(".json"), "istanbul").when(name.endswith(".xml"), "cobertura")


def lcov(rows: DataFrame) -> DataFrame:
    """(report, file, lines_found, lines_hit, functions_found, functions_hit, branches_found, branches_hit).

    ``rows`` (report, line_no, text). A running count of SF lines says which record a line belongs to.
    """
    order = Window.partitionBy("report").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.trim("text")
    own = rows.withColumn("record", F.sum(t.startswith("SF:").cast("int")).over(order)).filter("record > 0").withColumn("t", t)
    field = lambda p, g=1: F.regexp_extract("t", p, g)
    da, branch = r"^DA:(\d+),(\d+)", r"^BRDA:[^,]*,[^,]*,[^,]*,([^,]*)"
    return (
        own.groupBy("report", "record")
        .agg(
            F.max(F.when(F.col("t").startswith("SF:"), F.regexp_replace("t", "(?s)^SF:", ""))).alias("file"),
            F.countDistinct(F.when(field(da) != "", field(da))).alias("lines_found"),
            F.countDistinct(F.when(field(da, 2).try_cast("long") > 0, field(da))).alias("lines_hit"),
            F.countDistinct(F.when(F.col("t").startswith("FN:"), field(r"^FN:[^,]*,(.*)$"))).alias("functions_found"),
            F.countDistinct(F.when(field(r"^FNDA:(\d+),").try_cast("long") > 0, field(r"^FNDA:\d+,(.*)$"))).alias("functions_hit"),
            F.count(F.when(F.col("t").startswith("BRDA:"), 1)).alias("branches_found"),
            F.count(F.when(F.col("t").rlike(branch) & ~field(branch).isin("-", "0"), 1)).alias("branches_hit"),
        )
        .drop("record")
    )


def cobertura(rows: DataFrame) -> DataFrame:
    """(report, file, lines_found, lines_hit) of Cobertura lines, by the same running count."""
    order = Window.partitionBy("report").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("record", F.sum(F.col("text").contains("<class ").cast("int")).over(order)).filter("record > 0")
    number, hits = F.regexp_extract("text", r'<line [^>]*number="(\d+)"', 1), F.regexp_extract("text", r'<line [^>]*hits="(\d+)"', 1)
    return own.groupBy("report", "record").agg(F.max(F.when(F.col("text").contains("<class "), F.regexp_extract("text", r'filename="([^"]*)"', 1))).alias("file"), F.countDistinct(F.when(number != "", number)).alias("lines_found"), F.countDistinct(F.when(hits.try_cast("long") > 0, number)).alias("lines_hit")).drop("record")


def istanbul(reports: DataFrame) -> DataFrame:
    """(report, file, statements_found, statements_hit, functions_found, functions_hit) of Istanbul JSON texts."""
    kind = "map<string,struct<s:map<string,bigint>,f:map<string,bigint>>>"
    own = reports.select("report", F.explode(F.from_json("text", kind)).alias("file", "c"))
    hit = lambda m: F.size(F.filter(F.map_values(m), lambda n: n > 0))
    return own.select("report", "file", F.size("c.s").alias("statements_found"), hit("c.s").alias("statements_hit"), F.size("c.f").alias("functions_found"), hit("c.f").alias("functions_hit"))


def percent(hit: Column, found: Column) -> Column:
    return F.when(found == 0, 0.0).otherwise(100.0 * hit / found)


def confidence(factors: DataFrame) -> DataFrame:
    """(finding_id, score, level): weights summed and held between 0 and 1."""
    s = F.least(F.greatest(F.sum("weight"), F.lit(0.0)), F.lit(1.0))
    return factors.groupBy("finding_id").agg(F.round(s, 6).alias("score")).withColumn("level", F.when(F.col("score") > 0.7, "high").when(F.col("score") > 0.5, "medium").otherwise("low"))


def symbol_counts(usages: DataFrame) -> DataFrame:
    """(symbol, n, annotations, implementations) of usage rows (symbol, usage_kind)."""
    count = lambda k: F.count(F.when(F.col("usage_kind") == k, 1))
    return usages.groupBy("symbol").agg(F.count("*").alias("n"), count("type-annotation").alias("annotations"), count("implements").alias("implementations"))


def reachable_symbols(symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """Symbols with ``reachable``: whether an entry point has the name."""
    return symbols.join(entries.select("symbol").distinct().withColumn("e", F.lit(True)), "symbol", "left").withColumn("reachable", F.coalesce("e", F.lit(False))).drop("e")


def coverage_for(paths: DataFrame, covered: DataFrame) -> DataFrame:
    """(path, file): the covered file of a path: the same, else one that ends with it or that it ends with.

    Suffixes are joined by the last path part, so the comparison stays within equal names.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    near = paths.select("path", last(F.col("path")).alias("n")).join(covered.select("file", last(F.col("file")).alias("n")), "n")
    near = near.filter((F.col("path") == F.col("file")) | F.expr("endswith(path, file) OR endswith(file, path)"))
    return near.groupBy("path").agg(F.min_by("file", F.struct((F.col("path") != F.col("file")).alias("x"), "file")).alias("file"))


_INDEX = "path string, target string, start_line int, end_line int, signature string, sha256 string, kind string, calls array<struct<raw:string,line:int>>, placeholder boolean, forwards string, bases array<string>"


def _python_index(cap: int):
    import hashlib

    def name_of(f):
        return f.id if isinstance(f, ast.Name) else f"{name_of(f.value)}::{f.attr}" if isinstance(f, ast.Attribute) and isinstance(f.value, (ast.Name, ast.Attribute)) else f.attr if isinstance(f, ast.Attribute) else None

    def forwards(node):
        body = node.body
        if len(body) != 1 or not isinstance(body[0], ast.Return) or not isinstance(body[0].value, ast.Call):
            return None
        call = body[0].value
        mine = [a.arg for a in node.args.args if a.arg not in ("self", "cls")]
        theirs = [a.id if isinstance(a, ast.Name) else None for a in call.args]
        return name_of(call.func) if mine and mine == theirs and not call.keywords else None

    def unfinished(node):
        return any(isinstance(x, ast.Pass) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ...) or (isinstance(x, ast.Raise) and x.exc is not None and ("NotImplementedError" in ast.dump(x.exc) or "todo" in ast.dump(x.exc).lower())) for x in ast.walk(node))

    def entries(path, text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        rows = text.split("\n")

        def take(node, prefix, kind):
            source = "\n".join(rows[node.lineno - 1 : node.end_lineno])
            calls = sorted(((name_of(c.func), c.lineno) for c in ast.walk(node) if isinstance(c, ast.Call) and name_of(c.func)), key=lambda c: c[1])[:cap] if kind != "class" else []
            bases = [b for b in map(name_of, node.bases) if b] if kind == "class" else []
            return {"path": path, "target": prefix + node.name, "start_line": node.lineno, "end_line": node.end_lineno, "signature": rows[node.lineno - 1].strip(), "sha256": hashlib.sha256(source.encode("utf-8", "replace")).hexdigest(), "kind": kind, "calls": [{"raw": n, "line": ln} for n, ln in calls], "placeholder": kind != "class" and unfinished(node), "forwards": forwards(node) if kind != "class" else None, "bases": bases}

        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield take(node, "", "function")
            elif isinstance(node, ast.ClassDef):
                yield take(node, "", "class")
                for x in node.body:
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        yield take(x, f"{node.name}::", "method")

    def run(batches):
        calls = pa.list_(pa.struct([("raw", pa.string()), ("line", pa.int32())]))
        schema = pa.schema([("path", pa.string()), ("target", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("sha256", pa.string()), ("kind", pa.string()), ("calls", calls), ("placeholder", pa.bool_()), ("forwards", pa.string()), ("bases", pa.list_(pa.string()))])
        for batch in batches:
            out = [e for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for e in entries(p, t or "")]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def python_index(files: DataFrame, calls_per_function: int = 200) -> DataFrame:
    """Functions, methods and classes of Python files, with their calls: one Arrow pass, a file at a time."""
    ship(files.sparkSession)
    return files.filter(language(F.col("path")) == "python").select("path", "text").mapInArrow(_python_index(calls_per_function), _INDEX)


_CFG_NODES = "path string, function string, node int, kind string, line int, n_statements int"
_CFG = _CFG_NODES + ", edges array<struct<`to`:int,kind:string,condition:string>>"


def _python_cfg():
    exits = {"exit", "quit", "_exit", "abort"}

    class Build:
        """Nodes and edges of one function: a node for each straight run of statements and each branch."""

        def __init__(self, node):
            self.nodes, self.edges = [], []
            entry = self.node("entry", node.lineno)
            last = self.body(node.body, entry, [])
            if last is not None:
                self.edge(last, self.node("return", node.end_lineno), "next")

        def node(self, kind, line, n=0):
            self.nodes.append([kind, line, n])
            return len(self.nodes) - 1

        def edge(self, a, b, kind, condition=None):
            self.edges.append((a, b, kind, condition))

        def body(self, statements, at, loops):
            """The node after some statements, or None if none of them falls through."""
            for s in statements:
                if at is None:
                    at = self.node("block", s.lineno)  # nothing leads here
                if isinstance(s, (ast.Return, ast.Raise)):
                    self.edge(at, self.node("return" if isinstance(s, ast.Return) else "panic", s.lineno, 1), "next")
                    at = None
                elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and getattr(s.value.func, "attr", getattr(s.value.func, "id", "")) in exits:
                    self.edge(at, self.node("exit", s.lineno, 1), "next")
                    at = None
                elif isinstance(s, (ast.If, ast.While, ast.For, ast.AsyncFor)):
                    at = self.split(s, at, loops)
                elif isinstance(s, (ast.Break, ast.Continue)) and loops:
                    self.edge(at, loops[-1][isinstance(s, ast.Break)], "break" if isinstance(s, ast.Break) else "continue")
                    at = None
                elif isinstance(s, (ast.Try, ast.Match)):
                    parts = [s.body, *[h.body for h in s.handlers]] if isinstance(s, ast.Try) else [c.body for c in s.cases]
                    top = self.node("try" if isinstance(s, ast.Try) else "match", s.lineno)
                    self.edge(at, top, "next")
                    after = self.node("block", s.end_lineno)
                    for k, p in enumerate(parts):
                        start = self.node("block", p[0].lineno)
                        self.edge(top, start, "exception" if isinstance(s, ast.Try) and k else "next")
                        end = self.body(p, start, loops)
                        if end is not None:
                            self.edge(end, after, "next")
                    at = self.body(s.finalbody, after, loops) if isinstance(s, ast.Try) and s.finalbody else after
                elif isinstance(s, (ast.With, ast.AsyncWith)):
                    at = self.body(s.body, at, loops)
                else:
                    if self.nodes[at][0] != "block":
                        new = self.node("block", s.lineno)
                        self.edge(at, new, "next")
                        at = new
                    self.nodes[at][2] += 1
            return at

        def split(self, s, at, loops):
            loop = not isinstance(s, ast.If)
            test = ast.unparse(s.test if not isinstance(s, (ast.For, ast.AsyncFor)) else s.iter)
            top = self.node("loop" if loop else "branch", s.lineno)
            self.edge(at, top, "next")
            after = self.node("block", s.end_lineno)
            start = self.node("block", s.body[0].lineno)
            self.edge(top, start, "true-branch", test)
            end = self.body(s.body, start, [*loops, (top, after)] if loop else loops)
            if end is not None:
                self.edge(end, top if loop else after, "back" if loop else "next")
            if s.orelse:
                other = self.node("block", s.orelse[0].lineno)
                self.edge(top, other, "false-branch", test)
                end = self.body(s.orelse, other, loops)
                if end is not None:
                    self.edge(end, after, "next")
            else:
                self.edge(top, after, "false-branch", test)
            return after

    def run(batches):
        edge = pa.list_(pa.struct([("to", pa.int32()), ("kind", pa.string()), ("condition", pa.string())]))
        schema = pa.schema([("path", pa.string()), ("function", pa.string()), ("node", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("n_statements", pa.int32()), ("edges", edge)])
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                named = [("", n) for n in tree.body] + [(f"{c.name}::", n) for c in tree.body if isinstance(c, ast.ClassDef) for n in c.body]
                for prefix, f in named:
                    if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        b = Build(f)
                        for i, (kind, line, n) in enumerate(b.nodes):
                            out.append({"path": path, "function": prefix + f.name, "node": i, "kind": kind, "line": line, "n_statements": n, "edges": [{"to": t, "kind": k, "condition": c} for a, t, k, c in b.edges if a == i]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def python_cfg(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the control flow of every Python function: one Arrow pass, a file at a time."""
    ship(files.sparkSession)
    whole = files.filter(language(F.col("path")) == "python").select("path", "text").mapInArrow(_python_cfg(), _CFG)
    edges = whole.select("path", "function", F.col("node").alias("from"), F.explode("edges").alias("x")).select("path", "function", "from", "x.*")
    return whole.drop("edges"), edges
