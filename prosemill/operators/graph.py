"""Graphs of files, calls, control flow and data flow as (nodes, edges) DataFrames.

Loops carry their state as joins; nothing is collected but a changed-row flag. Keys that many
edges share are reduced by partial aggregates before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.session import cut, ship

#: Edges of a graph that is walked in one task with others, edges of such a task, edges that one task may join up.
MANY, TOGETHER, LOCAL = 10_000, 200_000, 500_000


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``resolved``: whether the target is a node."""
    known = nodes.select(F.col("path").alias("known")).distinct()
    return edges.join(known, F.col("to") == F.col("known"), "left").withColumn("resolved", F.col("known").isNotNull()).drop("known")


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("resolved"), 1)).alias("n_resolved"))


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "path") -> DataFrame:
    """(key, n_in, n_out) of every node, from resolved edges."""
    end = lambda c, i, o: F.struct(F.col(c).alias(key), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("from", 0, 1), end("to", 1, 0))).alias("e")).select("e.*")
    sums = ends.groupBy(key).agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select(key).join(sums, key, "left").select(key, F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


def hubs(nodes: DataFrame, edges: DataFrame, top: int = 10, key: str = "path") -> DataFrame:
    """The nodes with most edges, ties by key."""
    total = degrees(nodes, edges, key).withColumn("total", F.col("n_in") + F.col("n_out"))
    return total.filter("total > 0").orderBy(F.desc("total"), key).limit(top)


def roles(nodes: DataFrame, edges: DataFrame, key: str = "path") -> DataFrame:
    """One row: orphans without edges, sinks, sources, and nodes without inbound edges."""
    d = degrees(nodes, edges, key)
    count = lambda c: F.count(F.when(c, 1))
    i, o = F.col("n_in"), F.col("n_out")
    return d.agg(count((i == 0) & (o == 0)).alias("orphans"), count((i > 0) & (o == 0)).alias("sinks"), count((o > 0) & (i == 0)).alias("sources"), count(i == 0).alias("no_inbound"))


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "path") -> DataFrame:
    """Nodes that no resolved edge reaches."""
    return nodes.select(key).join(edges.select(F.col("to").alias(key)).distinct(), key, "left_anti")


def _reach(edges: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """``reachable`` by joins, a step of all graphs in each round. A round's rows are new, so it ends."""
    seen = front = cut(starts.select(*by, "node").distinct())
    while True:
        step = front.join(edges.select(*by, F.col("from").alias("node"), "to"), [*by, "node"]).select(*by, F.col("to").alias("node")).distinct()
        front = cut(step.join(seen, [*by, "node"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.union(front))


def _codes(*columns: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each distinct tuple of values."""
    code, n = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode")
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        values, code = np.unique(code * max(1, len(own.dictionary)) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        n = len(values)
    return code, n


def _reach_together(by: list[str]):
    """Many small graphs at once: what is seen grows along all edges until nothing is new."""

    def reach(edges: pa.Table, starts: pa.Table) -> pa.Table:
        every = pa.concat_tables([starts.select([*by, "node"]), *(edges.select([*by, c]).rename_columns([*by, "node"]) for c in ("from", "to"))])
        code, n = _codes(*(every[c] for c in every.column_names))
        k, m = starts.num_rows, edges.num_rows
        a, b = code[k : k + m], code[k + m :]
        seen = np.zeros(n, bool)
        seen[code[:k]] = True
        left = np.arange(m)
        while len(left):
            live = seen[a[left]]
            new = b[left[live]]
            left = left[~live]
            if not len(new) or seen[new].all():
                break
            seen[new] = True
        first = np.zeros(n, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        return every.take(pa.array(first[seen]))

    return reach


def reachable(edges: DataFrame, starts: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, node): what can be reached from the starts, these included, in each graph.

    Graphs of up to ``MANY`` edges are walked together, some hundred thousand edges in a task; larger ones, and edges
    without ``by``, by one join for each step.
    """
    by = list(by)
    ship(edges.sparkSession)
    if not by:
        return _reach(edges, starts, by)
    sizes = cut(edges.groupBy(*by).agg(F.count("*").alias("n")))
    told = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > MANY, 1)).alias("large")).first()
    key = F.pmod(F.xxhash64(*by), F.lit(max(8, told["n"] // TOGETHER)))
    e, s = edges.select(*by, "from", "to"), starts.select(*by, "node").distinct()
    large = sizes.filter(F.col("n") > MANY).select(*by)
    small_e, small_s = (x.join(large, by, "left_anti") if told["large"] else x for x in (e, s))
    near = small_e.withColumn("_key", key).groupBy("_key").cogroup(small_s.withColumn("_key", key).groupBy("_key")).applyInArrow(_reach_together(by), s.schema)
    return near.union(_reach(e.join(large, by, "left_semi"), s.join(large, by, "left_semi"), by)) if told["large"] else near


def unreachable(nodes: DataFrame, edges: DataFrame, starts: DataFrame, by: list[str] = ()) -> DataFrame:
    return nodes.join(reachable(edges, starts, by), [*by, "node"], "left_anti")


def _least_reached(edges: pa.Table) -> pa.Table:
    """(a, p): the least key that each end reaches."""
    both = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks], edges["a"].type)
    names = both.unique().take(pc.sort_indices(both.unique()))
    at = pc.index_in(both, names).to_numpy()
    a, b = at[: edges.num_rows], at[edges.num_rows :]
    label = np.arange(len(names))
    while len(a):
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return pa.table({"a": names, "p": names.take(pa.array(label))})


def components(nodes: DataFrame, edges: DataFrame, key: str = "path") -> DataFrame:
    """(key, component): the least key that each node reaches in either direction.

    Each round joins every node to its least neighbour, follows these steps to their ends, and draws the edges between
    the nodes that stay, at most half of all; up to ``LOCAL`` edges (they are counted) are finished in one task.
    """
    ship(edges.sparkSession)
    plain = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).filter("a <> b").distinct()
    labels, left = nodes.select(F.col(key), F.col(key).alias("component")).distinct(), cut(plain)
    while n := left.count():
        if n <= LOCAL:
            step = left.withColumn("_key", F.lit(0)).groupBy("_key").applyInArrow(lambda t: _least_reached(t), left.select("a", F.col("a").alias("p")).schema)
        else:
            near = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
            step, moved = cut(near), True
            while moved:  # steps double in length until all end at nodes that stay
                further = cut(step.join(step.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", "p", F.coalesce("q", "p").alias("q")))
                moved, step = further.filter("p <> q").limit(1).count(), further.select("a", F.col("q").alias("p"))
        step = cut(step) if n <= LOCAL else step
        labels = cut(labels.join(step, F.col("component") == F.col("a"), "left").select(key, F.coalesce("p", "component").alias("component")))
        if n <= LOCAL:
            break
        to = step.select(F.col("a").alias("b"), F.col("p").alias("q"))
        left = cut(left.join(step, "a").join(to, "b").filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
    return labels


def simple_paths(edges: DataFrame, entries: DataFrame, exits: DataFrame, by: list[str]) -> DataFrame:
    """(by, steps, conditions): paths from entries that stop at their first exit and visit no node twice.

    ``edges`` (by, from, to, kind, condition). Every path is carried as an array, however long: rounds end when no
    path is open, which must come because none visits a node twice.
    """
    own = cut(edges.select(*by, F.col("from").alias("node"), "to", F.when(F.col("condition").isNotNull(), F.concat(F.when(F.col("kind") == "false-branch", "!").otherwise(""), "condition")).alias("c")))
    last = cut(exits.select(*by, "node").distinct().withColumn("done", F.lit(True)))
    open_ = entries.select(*by, "node", F.array("node").alias("steps"), F.array().cast("array<string>").alias("conditions"))
    out = []
    while True:
        marked = cut(open_.join(last, [*by, "node"], "left"))
        out.append(marked.filter("done").select(*by, "steps", "conditions"))
        open_ = marked.filter("done IS NULL").drop("done").join(own, [*by, "node"]).filter(~F.array_contains("steps", F.col("to")))
        open_ = open_.select(*by, F.col("to").alias("node"), F.array_append("steps", F.col("to")).alias("steps"), F.when(F.col("c").isNull(), F.col("conditions")).otherwise(F.array_append("conditions", F.col("c"))).alias("conditions"))
        if not marked.filter("done IS NULL").limit(1).count():
            break
    return reduce(DataFrame.union, out)


def exit_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin("return", "exit", "panic", "diverge"))


def cfg_stats(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_nodes, n_exits, n_edges) of each graph with nodes; null keys are a graph, too."""
    kind = F.when(F.col("kind").isin("return", "exit", "panic", "diverge"), "exit").otherwise("node")
    parts = nodes.select(*by, kind.alias("_part")).union(edges.select(*by, F.lit("edge")))
    count = lambda *kinds: F.count(F.when(F.col("_part").isin(*kinds), 1))
    return parts.groupBy(*by).agg(count("node", "exit").alias("n_nodes"), count("exit").alias("n_exits"), count("edge").alias("n_edges")).filter("n_nodes > 0")


def dead_branches(nodes: DataFrame, edges: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """Nodes that no path from the entry reaches, but for entries, unplaced nodes and empty blocks."""
    return unreachable(nodes, edges, entries, by).filter((F.col("kind") != "entry") & (F.col("line") != 0) & ~((F.col("kind") == "block") & (F.col("n_statements") == 0)))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either snapshot alone, with ``change`` added or removed."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, keys, "left_anti").withColumn("change", F.lit("added")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(path, out, in): the sets of targets and sources."""
    out = edges.groupBy(F.col("from").alias("path")).agg(F.collect_set("to").alias("out"))
    into = edges.groupBy(F.col("to").alias("path")).agg(F.collect_set("from").alias("in"))
    return out.join(into, "path", "full")


def rename_candidates(removed: DataFrame, added: DataFrame, before: DataFrame, after: DataFrame, top: int = 3) -> DataFrame:
    """(old, new, score): likely new names of removed paths, by shared neighbours and base name.

    A score above 0 needs a common neighbour or base name, so candidates come from an equi-join on those, not from
    all pairs, and set sizes are counted: no node's neighbours are gathered.
    """

    def features(paths: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        end = lambda mine, other, kind: F.struct(F.col(mine).alias(name), F.lit(kind).alias("kind"), F.col(other).alias("other"))
        around = edges.select(F.explode(F.array(end("from", "to", "out"), end("to", "from", "in"))).alias("e")).select("e.*").distinct()
        own = paths.select(F.col("path").alias(name)).distinct()
        return around.join(own, name, "left_semi").unionByName(own.select(name, F.lit("base").alias("kind"), F.substring_index(name, "/", -1).alias("other")))

    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    old, new = features(removed, before, "old"), features(added, after, "new")
    sizes = lambda f, name: f.groupBy(name).agg(count("out").alias(f"{name}_out"), count("in").alias(f"{name}_in"))
    shared = old.join(new, ["kind", "other"]).groupBy("old", "new").agg(count("out").alias("out"), count("in").alias("in"), count("base").alias("base"))
    both = shared.join(sizes(old, "old"), "old").join(sizes(new, "new"), "new")
    overlap = lambda k: F.coalesce(F.try_divide(F.col(k), F.col(f"old_{k}") + F.col(f"new_{k}") - F.col(k)), F.lit(0.0))
    score = F.least(0.65 * overlap("out") + 0.35 * overlap("in") + F.when(F.col("base") > 0, 0.2).otherwise(0.0), F.lit(1.0))
    scored = both.withColumn("raw", score).filter("raw > 0").withColumn("score", F.round("raw", 3))
    order = Window.partitionBy("old").orderBy(F.desc("raw"), "new")
    return scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("old", "new", "score")


def mapping_template(removed: DataFrame, candidates: DataFrame) -> DataFrame:
    """One ``unmapped`` entry for each removed path, with its candidates."""
    found = candidates.groupBy(F.col("old").alias("path")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "new"))).alias("c"))
    return removed.select("path").distinct().join(found, "path", "left").select(F.col("path").alias("old"), F.lit("unmapped").alias("action"), F.coalesce(F.transform("c", lambda x: x["new"]), F.array().cast("array<string>")).alias("candidates"))


def mapping_issues(removed: DataFrame, mapping: DataFrame, after: DataFrame) -> DataFrame:
    """(old, issue) of a mapping (old, action, targets): what is unmapped, or maps to nothing or to missing paths."""
    joined = removed.select(F.col("path").alias("old")).distinct().join(mapping, "old", "left")
    targets = F.coalesce("targets", F.array().cast("array<string>"))
    moves = F.col("action").isin("moved", "renamed", "merged", "split")
    plain = joined.select("old", F.when(F.col("action").isNull() | ~(moves | (F.col("action") == "deleted")), "unmapped").when((F.col("action") == "deleted") & (F.size(targets) > 0), "deleted-with-targets").when(moves & (F.size(targets) == 0), "no-targets").alias("issue")).filter("issue IS NOT NULL")
    wanted = joined.filter(moves).select("old", F.explode(targets).alias("path"))
    missing = wanted.join(after.select("path").distinct(), "path", "left_anti").select("old", F.lit("missing-target").alias("issue")).distinct()
    return plain.unionByName(missing)


def resolve_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (file, caller, raw) with ``callee``: the id of the only function of that name, in the file first, else anywhere.

    Candidates are the raw name, its last two parts and its last part, in this order.
    """
    parts = F.filter(F.split("raw", "::"), lambda p: p != "")
    n = F.size(parts)
    tries = F.when(F.col("raw").contains("::"), F.array(F.col("raw"), F.when(n >= 2, F.concat(F.get(parts, n - 2), F.lit("::"), F.get(parts, n - 1))), F.get(parts, n - 1))).otherwise(F.array("raw"))
    call = ["file", "caller", "raw"]
    keyed = calls.withColumn("raw", F.trim("raw")).filter("raw <> ''")
    wanted = keyed.select(*call, F.posexplode(tries).alias("k", "target")).filter("target IS NOT NULL").distinct()
    local = functions.groupBy("file", "target").agg(F.min("id").alias("local"), F.count("*").alias("n")).filter("n = 1").drop("n")
    anywhere = functions.groupBy("target").agg(F.min("id").alias("anywhere"), F.count("*").alias("n")).filter("n = 1").drop("n")
    hit = wanted.join(local, ["file", "target"], "left").join(anywhere, "target", "left").withColumn("callee", F.coalesce("local", "anywhere")).filter("callee IS NOT NULL")
    best = hit.groupBy(*call).agg(F.min_by("callee", "k").alias("callee"))
    return keyed.join(best, call, "left")


def pass_chains(links: DataFrame, most: int = 20) -> DataFrame:
    """(file, root, chain): what forwards to what, from functions that nothing forwards to; 2 links or more, no cycles."""
    own = links.select("file", F.col("caller").alias("at"), "callee")
    roots = links.select("file", F.col("caller").alias("root")).distinct().join(links.select("file", F.col("callee").alias("root")).distinct(), ["file", "root"], "left_anti")
    now = roots.select("file", "root", F.col("root").alias("at"), F.array("root").alias("chain"))
    for _ in range(most):
        step = now.join(own, ["file", "at"], "left")
        on = F.col("callee").isNotNull() & ~F.array_contains("chain", F.col("callee"))
        now = step.select("file", "root", F.when(on, F.col("callee")).alias("at"), F.when(on, F.array_append("chain", F.col("callee"))).otherwise(F.col("chain")).alias("chain"))
    return now.filter(F.size("chain") >= 3).select("file", "root", "chain")


def flows(defs: DataFrame, uses: DataFrame, by: list[str]) -> DataFrame:
    """Each use with the latest definition of its variable at or before its line (ties: the last inserted).

    One sort by line carries the last definition forward; there is no inequality join.
    """
    key = [*by, "variable"]
    d = defs.select(*key, "line", F.lit(0).alias("is_use"), F.col("ord"), F.struct(F.col("line").alias("line"), "kind").alias("d"), F.lit(None).cast("string").alias("use_kind"))
    u = uses.select(*key, "line", F.lit(1).alias("is_use"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast(d.schema["d"].dataType).alias("d"), F.col("kind").alias("use_kind"))
    order = Window.partitionBy(*key).orderBy("line", "is_use", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.unionByName(u).withColumn("latest", F.last("d", ignorenulls=True).over(order)).filter("is_use = 1").select(*key, "line", "use_kind", F.col("latest.line").alias("def_line"), F.col("latest.kind").alias("def_kind"))


def unvalidated(params: DataFrame, uses: DataFrame, by: list[str]) -> DataFrame:
    """Parameters that no condition, assertion or comparison checks before they index something; unused ones count as checked."""
    check = F.col("kind").isin("condition", "assertion", "comparison")
    seen = uses.groupBy(*by, F.col("variable").alias("name")).agg(F.count("*").alias("n"), F.min(F.when(check, F.col("line"))).alias("checked"), F.min(F.when(F.col("kind") == "index", F.col("line"))).alias("indexed"))
    joined = params.join(seen, [*by, "name"], "left")
    return joined.filter((F.col("n") > 0) & (F.col("checked").isNull() | (F.col("checked") >= F.col("indexed")))).select(*params.columns)


def unchecked_unwraps(defs: DataFrame, transformations: DataFrame, by: list[str]) -> DataFrame:
    """(by, parameter, unwrap_line, param_line): what is unwrapped while its latest definition is a parameter."""
    found = flows(defs, transformations.filter(F.col("kind").isin("unwrap", "expect")), by).filter("def_kind = 'param'")
    return found.select(*by, F.col("variable").alias("parameter"), F.col("line").alias("unwrap_line"), F.col("def_line").alias("param_line"))


def escalations(uses: DataFrame, by: list[str]) -> DataFrame:
    """(by, variable, warning_line, error_line): uses in a warning context before uses in an error context."""
    key = [*by, "variable"]
    w = uses.filter(F.lower("context").contains("warn")).select(*key, F.col("line").alias("warning_line"))
    e = uses.filter(F.lower("context").contains("error")).select(*key, F.col("line").alias("error_line"))
    return w.join(e, key).filter("warning_line < error_line")


def edge_kind(kind: Column) -> Column:
    """One of ``mod``, ``use``, ``import``, or ``other``, whatever the case and plural of a kind."""
    k = F.regexp_replace(F.lower(F.trim(kind)), "s$", "")
    return F.when(k.isin("mod", "use", "import"), k).otherwise("other")


def shown_edges(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, resolved_only: bool = False) -> DataFrame:
    """Edges of some kinds whose ends are both nodes."""
    out = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    out = out.filter("resolved") if resolved_only else out
    known = nodes.select("path").distinct()
    out = out.join(known.withColumnRenamed("path", "_from"), F.col("from") == F.col("_from"), "left_semi")
    return out.join(known.withColumnRenamed("path", "_to"), F.col("to") == F.col("_to"), "left_semi")


def component_sizes(labels: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, languages) of labelled components."""
    ids = labels.select(F.col("path").alias("from"), "component")
    inside = edges.join(ids, "from").groupBy("component").agg(F.count("*").alias("n_edges"))
    by_language = labels.join(nodes.select("path", "language"), "path").groupBy("component", "language").count()
    sizes = by_language.groupBy("component").agg(F.sum("count").alias("n_nodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "count")))).alias("languages"))
    return sizes.join(inside, "component", "left").na.fill(0, ["n_edges"])


def call_lists(calls: DataFrame, function: str) -> DataFrame:
    """(role, other, n): callers of a function, what it calls, and its unresolved calls."""
    into = calls.filter(F.col("callee") == function).select(F.lit("caller").alias("role"), F.col("caller").alias("other"))
    out = calls.filter((F.col("caller") == function) & F.col("callee").isNotNull()).select(F.lit("callee"), "callee")
    lost = calls.filter((F.col("caller") == function) & F.col("callee").isNull()).select(F.lit("unresolved"), "raw")
    return into.union(out).union(lost).groupBy("role", "other").agg(F.count("*").alias("n"))


def guard(before_nodes: DataFrame, after_nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(old, issue) of a refactoring: removed paths that a mapping does not explain. Empty means it may pass."""
    removed = snapshot_diff(before_nodes, after_nodes, ["path"]).filter("change = 'removed'")
    return mapping_issues(removed, mapping, after_nodes)


def exit_path_findings(paths: DataFrame, by: list[str]) -> DataFrame:
    """(by, steps, conditions, contradiction) of paths of more than two nodes under a condition; a path that needs a condition and its opposite cannot run."""
    own = paths.filter((F.size("steps") > 2) & (F.size("conditions") >= 1))
    opposite = F.exists("conditions", lambda c: F.array_contains("conditions", F.concat(F.lit("!"), c)))
    own = own.withColumn("contradiction", opposite)
    return own.withColumn("steps", F.array_join("steps", " -> ")).withColumn("conditions", F.array_join("conditions", " && ")).select(*by, "steps", "conditions", "contradiction")
