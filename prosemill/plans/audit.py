"""Audits of a tree of source files in one call: structure (``audit``) and logic (``logic_audit``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import line_slice
from prosemill.operators import braces as B
from prosemill.operators import code as K
from prosemill.operators import graph as G
from prosemill.operators.repo import language

#: Python bases that make a class an abstraction.
ABSTRACT = ("ABC", "Protocol", "abc::ABC", "typing::Protocol")


def index(files: DataFrame) -> DataFrame:
    """Functions, methods and types of all languages, with ``language``."""
    return K.python_index(files).unionByName(B.source_index(files)).withColumn("language", language(F.col("path")))


def abstractions(indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(language, name, path, line, allowed) of traits, interfaces and abstract classes; (name) of what implements them, by language."""
    python = (F.col("kind") == "class") & (F.col("language") == "python")
    abstract = F.arrays_overlap("bases", F.array(*map(F.lit, ABSTRACT)))
    named = lambda c: F.concat("language", F.lit(":"), c)
    own = indexed.filter(F.col("kind").isin("trait", "interface") | (python & abstract))
    definitions = own.select("language", "target", "path", F.col("start_line").alias("line"), named("target").alias("name"), F.lit(False).alias("allowed"))
    made = indexed.filter((F.col("kind") == "implements") | python).select("language", F.explode("bases").alias("base"))
    return definitions, made.select(named(F.substring_index("base", "::", -1)).alias("name"))


def audit(files: DataFrame, min_tokens: int = 80, min_instances: int = 3) -> DataFrame:
    """(category, language, path, line, symbol, severity) of files (path, text): lonely abstractions, pass-through functions, placeholders and duplicated bodies.

    Files are parsed once for each language family and once for bodies; findings meet by unions, and what must be
    counted across files is one aggregate each.
    """
    indexed = index(files)
    row = lambda df, category, line, symbol, severity: df.select(F.lit(category).alias("category"), "language", "path", line.cast("int").alias("line"), symbol.alias("symbol"), severity.alias("severity"))
    line = F.col("start_line")
    through = row(indexed.filter("forwards IS NOT NULL"), "pass-through", line, F.concat("target", F.lit(" -> "), "forwards"), F.lit("warning"))
    unfinished = row(K.placeholders(files).withColumn("language", language(F.col("path"))), "placeholder", F.col("line"), F.lit(None).cast("string"), F.col("severity"))
    definitions, made = abstractions(indexed)
    lonely = row(K.lonely(definitions, made), "lonely-abstraction", F.col("line"), F.col("target"), F.lit("warning"))
    bodies = indexed.filter(F.col("kind").isin("function", "method")).select("language", "path", "start_line", "end_line", "target")
    bodies = bodies.join(files.select("path", "text"), "path").select("language", "path", F.col("start_line").alias("line"), F.col("target").alias("symbol"), line_slice(F.col("text"), F.col("start_line"), F.col("end_line")).alias("text"))
    twice = row(K.duplicates(bodies, min_tokens, min_instances), "duplication", F.col("line"), F.get("evidence", F.lit(0)), F.lit("warning"))
    return reduce(DataFrame.unionByName, [through, unfinished, lonely, twice])


def logic_audit(files: DataFrame) -> DataFrame:
    """(category, path, function, line, detail) of Rust functions and methods: exit paths and dead branches; of Rust functions: validation gaps and escalations."""
    rust = files.filter(language(F.col("path")) == "rust")
    nodes, edges = B.source_cfg(rust)
    by = ["path", "function"]
    entries = nodes.filter("kind = 'entry'").select(*by, "node", "line")
    paths = G.exit_path_findings(G.simple_paths(edges, entries.select(*by, "node"), G.exit_nodes(nodes), by), by)
    exits = paths.join(entries.select(*by, "line"), by).select(F.lit("exit-path").alias("category"), *by, "line", F.col("conditions").alias("detail"))
    dead = G.dead_branches(nodes, edges, entries.select(*by, "node"), by).select(F.lit("dead-branch").alias("category"), *by, "line", F.col("kind").alias("detail"))
    flow = B.rust_flow(rust).filter(~F.col("function").contains("::"))
    params, uses, _ = parts(flow)
    gaps = G.unvalidated(params.select(*by, F.col("variable").alias("name"), "line"), uses, by).select(F.lit("validation-gap").alias("category"), *by, "line", F.col("name").alias("detail"))
    grown = G.escalations(uses, by).select(F.lit("escalation").alias("category"), *by, F.col("error_line").alias("line"), F.col("variable").alias("detail"))
    return reduce(DataFrame.unionByName, [exits, dead, gaps, grown])


def parts(flow: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parameters, uses, transformations) of what ``rust_flow`` found; parameters are definitions too."""
    kinds = lambda *k: flow.filter(F.col("kind").isin(*k))
    return kinds("param"), kinds("read", "condition", "index", "assertion", "return"), kinds("unwrap", "expect")
