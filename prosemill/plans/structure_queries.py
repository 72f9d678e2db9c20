"""Repository, graph, code, coverage and specification operators over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators import braces as B
from prosemill.operators import code as K
from prosemill.operators import flowspec as S
from prosemill.operators import graph as G
from prosemill.operators import repo as R
from prosemill.plans import audit as A
from prosemill.plans.catalog import query, table
from prosemill.sources import sinks
from prosemill.streaming import live

# Names that file trees hold, by doc_id modulo their number.
NAMES = ["report.md", "report copy.md", "main.py", "main_old.py", "data.json", "package-lock.json", "yarn.lock", "notes(1).txt", "README.md", "experiment_x.py", "App.tsx", "table.csv"]
DIRS = ["src", "docs", "ui", "__pycache__", "output", "scripts", "data"]


def files(spark, sf_dir) -> DataFrame:
    """A file tree: one path for each document."""
    d = table(spark, sf_dir, "documents")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    i = F.col("doc_id")
    path = F.when(i % 97 == 0, F.concat(F.lit("notes"), i.cast("string"), F.lit(".md"))).otherwise(F.concat_ws("/", F.lit("tree"), (i / 60).cast("long").cast("string"), pick(DIRS, (i / 7).cast("long")), pick(NAMES, i)))
    return d.select(path.alias("path"), (F.col("n_chars") * 200).alias("size_bytes"), (i % 3 != 0).alias("git_tracked"), "text", "doc_id")


FILES = f"""f AS (SELECT CASE WHEN doc_id % 97 = 0 THEN 'notes' || doc_id || '.md' ELSE 'tree/' || (doc_id // 60) || '/' || (['{"', '".join(DIRS)}'])[CAST((doc_id // 7) % {len(DIRS)} + 1 AS INTEGER)] || '/' || (['{"', '".join(NAMES)}'])[CAST(doc_id % {len(NAMES)} + 1 AS INTEGER)] END AS path, n_chars * 200 AS size_bytes, doc_id % 3 <> 0 AS git_tracked, text, doc_id FROM documents),
n AS (SELECT *, string_split(path, '/')[-1] AS name, lower(regexp_extract(string_split(path, '/')[-1], '[^.]\\.([^.]+)$', 1)) AS ext FROM f)"""


@query(f"WITH {FILES} SELECT path, size_bytes FROM n WHERE ext IN ('md', 'markdown', 'mdx', 'txt', 'rst') AND NOT path LIKE '%/output/%'")
def scan_prose(spark, sf_dir):
    return R.scanned(files(spark, sf_dir), ignore=("**/output/**",)).select("path", "size_bytes")


@query(f"WITH {FILES} SELECT path, CASE ext WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' END AS language FROM n WHERE ext IN ('py', 'tsx') AND size_bytes <= 512 * 1024")
def scan_code(spark, sf_dir):
    return R.scanned(files(spark, sf_dir), tuple(R.CODE), max_kb=512).select("path", R.language(F.col("path")).alias("language"))


_ISSUES = r"""
own AS (SELECT * FROM n WHERE NOT path LIKE '%/__pycache__/%'),
i AS (
  SELECT DISTINCT 'banned-dir' AS category, regexp_extract(path, '^(.*?/__pycache__)/', 1) AS path FROM n WHERE path LIKE '%/__pycache__/%'
  UNION ALL SELECT 'slop', path FROM own WHERE regexp_matches(path, 'copy|backup|old|new|final|\(1\)|\(2\)|-draft') AND regexp_matches(name, 'copy|backup|old|new|final|\(1\)|\(2\)|-draft')
  UNION ALL SELECT 'suspicious-name', path FROM own WHERE regexp_matches(name, '(?i)copy|backup|old|new|final|\(\d+\)|-draft|cleanup|helper|utils2|script_final')
  UNION ALL SELECT 'lockfile', p FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS p, count(DISTINCT name) AS c FROM own WHERE name IN ('package-lock.json', 'yarn.lock') GROUP BY 1) WHERE c > 1
  UNION ALL SELECT 'large-json', path FROM own WHERE ext = 'json' AND size_bytes > 512000
  UNION ALL SELECT 'stray-markdown', path FROM own WHERE NOT contains(path, '/') AND ext = 'md' AND contains(name, 'notes')
)"""


@query(f"WITH {FILES}, {_ISSUES} SELECT category, path, count(*) AS n FROM i GROUP BY ALL")
def repo_issues(spark, sf_dir):
    return R.issues(files(spark, sf_dir)).filter("category <> 'dup-variants'").groupBy("category", "path").agg(F.count("*").alias("n"))


@query(rf"""WITH {FILES}, c AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS directory, CASE WHEN name = 'report copy.md' THEN 'report.md' WHEN name = 'main_old.py' THEN 'main.py' WHEN name = 'notes(1).txt' THEN 'notes.txt' ELSE replace(replace(lower(name), '_', '-'), ' ', '-') END AS canonical FROM n)
SELECT directory, canonical, string_agg(DISTINCT path, ',' ORDER BY path) AS members FROM c GROUP BY ALL HAVING count(DISTINCT path) > 1""")
def duplicate_variants(spark, sf_dir):
    return R.duplicate_variants(files(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


_ORGANIZE = r"""o AS (SELECT path, CASE
  WHEN NOT git_tracked AND contains('/' || path, '/output/') THEN ['untracked-experiment', 'gitignore', regexp_extract(path, '^(.*?/output)/', 1)]
  WHEN regexp_matches(name, '_v[0-9]|_old|_backup|_copy|^copy of |\.bak$|~$|\.orig$') THEN ['legacy', 'archive', 'archive/' || name]
  WHEN ext IN ('json', 'csv') AND size_bytes >= 102400 AND NOT regexp_matches('/' || path, '/(scripts|output|data)/') THEN ['data-in-source', 'move', 'data/' || name]
  WHEN ext = 'py' AND contains(path, 'ui/') AND NOT contains('/' || path, '/scripts/') THEN ['misplaced', 'move', 'scripts/' || name]
  WHEN NOT git_tracked AND ext = 'py' AND contains(name, 'experiment') THEN ['untracked-experiment', 'move', 'scratch/' || name] END AS v FROM n)"""


@query(f"WITH {FILES}, {_ORGANIZE} SELECT path, v[1] AS issue, v[2] AS action, v[3] AS target, count(*) AS n FROM o WHERE v IS NOT NULL GROUP BY ALL")
def organize(spark, sf_dir):
    return R.organize(files(spark, sf_dir)).groupBy("path", "issue", "action", "target").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, {_ORGANIZE} SELECT v[1] AS issue, count(*) AS n FROM o WHERE v IS NOT NULL GROUP BY ALL")
def organize_summary(spark, sf_dir):
    return R.organize_summary(R.organize(files(spark, sf_dir)))


@query()
def organize_prompt(spark, sf_dir):
    return R.organize_prompt(R.organize(files(spark, sf_dir)))


@query("SELECT 'mixed' AS kind, 0.3::DOUBLE AS confidence")
def repo_type(spark, sf_dir):
    return R.repo_type(files(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


@query(rf"WITH {FILES} SELECT path, regexp_replace(path, '^([^/]*)/.*$', '\1') AS top, regexp_matches(name, '_v[0-9]|_old|_backup|_copy|^copy of |\.bak$|~$|\.orig$') AS legacy, count(*) AS n FROM n GROUP BY ALL")
def path_functions(spark, sf_dir):
    d = files(spark, sf_dir)
    return d.select("path", F.regexp_replace("path", "^([^/]*)/.*$", "$1").alias("top"), R.legacy(R.file_name(F.col("path"))).alias("legacy")).groupBy("path", "top", "legacy").agg(F.count("*").alias("n"))


# A graph of parts and their suppliers, with kinds by order flags.
EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS \"from\", 's' || l_suppkey AS \"to\", CASE WHEN l_returnflag = 'R' THEN 'use' ELSE 'import' END AS kind FROM lineitem), v AS (SELECT 'p' || p_partkey AS path FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)"


def edges(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.concat(F.lit("p"), "l_partkey").alias("from"), F.concat(F.lit("s"), "l_suppkey").alias("to"), F.when(F.col("l_returnflag") == "R", "use").otherwise("import").alias("kind")).distinct()


def vertices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path")).union(table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.concat(F.lit("s"), "s_suppkey")))


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = vertices(spark, sf_dir)
    return v, G.resolved(edges(spark, sf_dir), v).filter("resolved")


RESOLVED = EDGES + ", r AS (SELECT * FROM e SEMI JOIN v ON e.\"to\" = v.path), d AS (SELECT path, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM v LEFT JOIN (SELECT \"from\" AS path, count(*) AS o FROM r GROUP BY 1) USING (path) LEFT JOIN (SELECT \"to\" AS path, count(*) AS i FROM r GROUP BY 1) USING (path))"


@query(f"WITH {EDGES} SELECT kind, count(*) AS n, count(v.path) AS n_resolved FROM e LEFT JOIN v ON e.\"to\" = v.path GROUP BY kind")
def edge_stats(spark, sf_dir):
    return G.edge_stats(G.resolved(edges(spark, sf_dir), vertices(spark, sf_dir)))


@query(f"WITH {RESOLVED} SELECT path, i AS n_in, o AS n_out FROM d")
def degrees(spark, sf_dir):
    return G.degrees(*_linked(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT path, i AS n_in, o AS n_out, i + o AS total FROM d WHERE i + o > 0 ORDER BY total DESC, path LIMIT 10")
def hubs(spark, sf_dir):
    return G.hubs(*_linked(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT count(*) FILTER (i = 0 AND o = 0) AS orphans, count(*) FILTER (i > 0 AND o = 0) AS sinks, count(*) FILTER (o > 0 AND i = 0) AS sources, count(*) FILTER (i = 0) AS no_inbound FROM d")
def roles(spark, sf_dir):
    return G.roles(*_linked(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT path FROM d WHERE i = 0")
def orphans(spark, sf_dir):
    return G.orphans(*_linked(spark, sf_dir))


# Two snapshots: edges of part keys under different remainders.
@query("""WITH a AS (SELECT DISTINCT l_partkey % 500 AS f, l_suppkey AS t FROM lineitem WHERE l_partkey % 3 <> 0), b AS (SELECT DISTINCT l_partkey % 500 AS f, l_suppkey AS t FROM lineitem WHERE l_partkey % 3 <> 1)
SELECT f AS "from", t AS "to", 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT f, t, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def snapshot_diff(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    side = lambda k: d.filter(f"l_partkey % 3 <> {k}").select((F.col("l_partkey") % 500).alias("from"), F.col("l_suppkey").alias("to"))
    return G.snapshot_diff(side(0), side(1), ["from", "to"])


def _snapshots(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = lambda p: F.concat(F.lit(p), F.lower("n_name"))
    before = n.select(name("old/").alias("from"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("to"))
    after = n.select(name("new/").alias("from"), F.concat(F.lit("r"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).otherwise((F.col("n_regionkey") + 1) % 5)).alias("to"))
    return before, after


RENAMES = """b AS (SELECT 'old/' || lower(n_name) AS f, 'r' || n_regionkey AS t FROM nation), a AS (SELECT 'new/' || lower(n_name) AS f, 'r' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE (n_regionkey + 1) % 5 END AS t FROM nation),
s AS (SELECT b.f AS old, a.f AS new, least(0.65 * (b.t = a.t)::INT + 0.2 * (b.f[5:] = a.f[5:])::INT, 1.0)::DOUBLE AS score FROM b, a)"""


@query(f"WITH {RENAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY score DESC, new) AS k FROM s WHERE score > 0) SELECT old, new, round(score, 3) AS score FROM k WHERE k <= 3")
def rename_candidates(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    side = lambda e: e.select(F.col("from").alias("path")).distinct()
    return G.rename_candidates(side(before), side(after), before, after)


@query(f"WITH {RENAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY score DESC, new) AS k FROM s WHERE score > 0) SELECT old, 'unmapped' AS action, count(*) AS candidates FROM k WHERE k <= 3 GROUP BY old")
def mapping_template(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    side = lambda e: e.select(F.col("from").alias("path")).distinct()
    found = G.rename_candidates(side(before), side(after), before, after)
    return G.mapping_template(side(before), found).select("old", "action", F.size("candidates").cast("long").alias("candidates"))


@query("""SELECT 'p' || p_partkey AS old, CASE p_partkey % 6 WHEN 0 THEN 'unmapped' WHEN 1 THEN 'deleted-with-targets' WHEN 2 THEN 'no-targets' WHEN 3 THEN 'missing-target' WHEN 4 THEN 'unmapped' END AS issue FROM part WHERE p_partkey % 6 < 5""")
def mapping_issues(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), (F.col("p_partkey") % 6).alias("k"))
    none = F.array().cast("array<string>")
    m = p.filter("k > 0").select(F.col("path").alias("old"), F.when(F.col("k") == 1, "deleted").when(F.col("k") == 4, "shuffled").otherwise("moved").alias("action"), F.when(F.col("k") == 2, none).when(F.col("k") == 3, F.array(F.lit("nowhere"))).otherwise(F.array("path")).alias("targets"))
    return G.mapping_issues(p, m, p)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'n' || o_custkey AS a, 'n' || o_orderkey AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(path, component) USING KEY (path) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a UNION
  SELECT u.a, min(c.component) FROM c JOIN u ON u.b = c.path JOIN recurring.c AS r ON r.path = u.a WHERE c.component < r.component GROUP BY u.a)
SELECT path, component FROM c""")
def graph_components(spark, sf_dir):
    """Customers and orders with equal keys are one node, so components chain through them."""
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    e = table(spark, sf_dir, "orders").select(name("o_custkey").alias("from"), name("o_orderkey").alias("to")).distinct()
    return G.components(e.select(F.explode(F.array("from", "to")).alias("path")).distinct(), e)


# Control flow: each order is a graph of its lines, in order, with jumps by line flags.
def _cfg(spark, sf_dir):
    """Of the rows of one order and line, the first of the table (by file, then row) counts, however it is split."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = F.min(F.struct(*place, (F.col("l_quantity") > 25).alias("big"), F.col("l_linestatus").alias("s")))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("node")).agg(first.alias("first")).select("fn", "node", "first.big", "first.s")
    nodes = li.select("fn", "node", F.when(F.col("node") == 1, "entry").when((F.col("s") == "F") & F.col("node").isNotNull(), "return").otherwise("block").alias("kind"), F.col("node").alias("line"), F.col("big").cast("int").alias("n_statements"), "s")
    to = F.when(F.col("big"), F.col("node") + 2).otherwise(F.col("node") + 1)
    e = li.select("fn", F.col("node").alias("from"), to.alias("to"), F.when(F.col("big"), "true-branch").otherwise("next").alias("kind"), F.when(F.col("big"), F.lit("q > 25")).alias("condition"))
    return nodes, e


_CFG = """l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS fn, l_linenumber AS node, l_quantity > 25 AS big, l_linestatus AS s FROM lineitem), e AS (SELECT fn, node AS a, node + CASE WHEN big THEN 2 ELSE 1 END AS b FROM l)"""


@query(f"WITH RECURSIVE {_CFG}, r(fn, node) AS (SELECT fn, node FROM l WHERE node = 1 UNION SELECT r.fn, e.b FROM r JOIN e ON r.fn = e.fn AND r.node = e.a) SELECT fn, count(*) AS n, sum(node)::BIGINT AS s FROM r SEMI JOIN l ON r.fn = l.fn AND r.node = l.node GROUP BY fn")
def cfg_reachable(spark, sf_dir):
    nodes, e = _cfg(spark, sf_dir)
    seen = G.reachable(e, nodes.filter("kind = 'entry'"), ["fn"])
    return seen.join(nodes.select("fn", "node"), ["fn", "node"], "left_semi").groupBy("fn").agg(F.count("*").alias("n"), F.sum("node").cast("long").alias("s"))


@query(f"WITH RECURSIVE {_CFG}, r(fn, node) AS (SELECT fn, node FROM l WHERE node = 1 UNION SELECT r.fn, e.b FROM r JOIN e ON r.fn = e.fn AND r.node = e.a) SELECT fn, node, node AS line FROM l ANTI JOIN r ON r.fn = l.fn AND r.node = l.node WHERE node <> 1 AND (s = 'F' OR big)")
def cfg_dead_branches(spark, sf_dir):
    nodes, e = _cfg(spark, sf_dir)
    return G.dead_branches(nodes, e, nodes.filter("kind = 'entry'").select("fn", "node"), ["fn"]).select("fn", "node", "line")


@query(f"""WITH RECURSIVE {_CFG}, p(fn, node, path, done) AS (SELECT fn, node, [node], FALSE FROM l WHERE node = 1 UNION ALL SELECT p.fn, e.b, list_append(path, e.b), l.s = 'F' AND l.node <> 1 FROM p JOIN e ON p.fn = e.fn AND p.node = e.a JOIN l ON l.fn = e.fn AND l.node = e.b WHERE NOT done)
SELECT fn, array_to_string(path, '>') AS path FROM p WHERE done""")
def cfg_paths(spark, sf_dir):
    nodes, e = _cfg(spark, sf_dir)
    # a line without a status is neither exit nor block: paths to it stay unfinished
    real = e.join(nodes.filter("s IS NOT NULL").select("fn", F.col("node").alias("to")), ["fn", "to"], "left_semi")
    found = G.simple_paths(real, nodes.filter("kind = 'entry'"), G.exit_nodes(nodes), ["fn"])
    return found.select("fn", F.array_join("steps", ">").alias("path"))


@query(f"WITH {_CFG} SELECT fn, count(*) AS n_nodes, count(*) FILTER (s = 'F' AND node <> 1) AS n_exits, count(*) AS n_edges FROM l GROUP BY fn")
def cfg_stats(spark, sf_dir):
    return G.cfg_stats(*_cfg(spark, sf_dir), ["fn"])


@query()
def cfg_mermaid(spark, sf_dir):
    return sinks.mermaid(*_cfg(spark, sf_dir), ["fn"])


# Data flow: events of a user are a function; purchases define, the rest use.
_DEFS = "d AS (SELECT user_id AS fn, event_type AS variable, event_id // 10 AS line, event_id AS ord FROM events WHERE event_id % 3 = 0), u AS (SELECT user_id AS fn, event_type AS variable, event_id // 10 AS line, event_id % 4 AS k FROM events WHERE event_id % 3 <> 0)"


def _dfg(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), F.col("event_type").alias("variable"), (F.col("event_id") / 10).cast("long").alias("line"), F.col("event_id"))
    kind = F.element_at(F.array(*map(F.lit, ["read", "condition", "index", "argument"])), (F.col("event_id") % 4 + 1).cast("int"))
    defs = e.filter("event_id % 3 = 0").select("fn", "variable", "line", F.lit("let").alias("kind"), F.col("event_id").alias("ord"))
    uses = e.filter("event_id % 3 <> 0").select("fn", "variable", "line", kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "warning_count").otherwise("error_count").alias("context"), "event_id")
    return defs, uses


@query(f"WITH {_DEFS}, m AS (SELECT u.fn, u.variable, u.line, (SELECT max(d.line) FROM d WHERE d.fn = u.fn AND d.variable = u.variable AND d.line <= u.line) AS def_line FROM u) SELECT fn, variable, line, coalesce(def_line, -1) AS def_line, count(*) AS n FROM m GROUP BY ALL")
def dataflow(spark, sf_dir):
    found = G.flows(*_dfg(spark, sf_dir), ["fn"]).withColumn("def_line", F.coalesce("def_line", F.lit(-1).cast("long")))
    return found.groupBy("fn", "variable", "line", "def_line").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id AS fn, event_type AS name, min(CASE WHEN event_id % 4 = 1 THEN event_id // 10 END) AS c, min(CASE WHEN event_id % 4 = 2 THEN event_id // 10 END) AS x FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
SELECT fn, name FROM u WHERE c IS NULL OR c >= x""")
def unvalidated_params(spark, sf_dir):
    _, uses = _dfg(spark, sf_dir)
    return G.unvalidated(uses.select("fn", F.col("variable").alias("name")).distinct(), uses, ["fn"])


@query("""WITH u AS (SELECT user_id AS fn, event_type AS variable, event_id // 10 AS line, event_id % 2 = 0 AS w FROM events WHERE event_id % 3 <> 0) SELECT a.fn, a.variable, a.line AS warning_line, b.line AS error_line, count(*) AS n FROM u a JOIN u b ON a.fn = b.fn AND a.variable = b.variable AND a.w AND NOT b.w AND a.line < b.line GROUP BY ALL""")
def escalations(spark, sf_dir):
    _, uses = _dfg(spark, sf_dir)
    return G.escalations(uses, ["fn"]).groupBy("fn", "variable", "warning_line", "error_line").agg(F.count("*").alias("n"))


# Calls: customers are functions in the file of their nation, orders call by priority names.
@query("""WITH f AS (SELECT 'n' || c_nationkey AS file, 'id' || c_custkey AS id, 'A::m' || (c_custkey % 700) AS target FROM customer), k AS (SELECT DISTINCT 'n' || (o_custkey % 25) AS file, 'A::m' || (o_orderkey % 700) AS raw FROM orders),
l AS (SELECT file, target, min(id) AS id FROM f GROUP BY ALL HAVING count(*) = 1), g AS (SELECT target, min(id) AS id FROM f GROUP BY ALL HAVING count(*) = 1)
SELECT k.file, raw, coalesce(l.id, g.id) AS callee FROM k LEFT JOIN l ON k.file = l.file AND l.target = raw LEFT JOIN g ON g.target = raw""")
def callee_resolution(spark, sf_dir):
    fs = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("file"), F.concat(F.lit("id"), "c_custkey").alias("id"), F.concat(F.lit("A::m"), F.col("c_custkey") % 700).alias("target"))
    calls = table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("file"), F.lit("x").alias("caller"), F.concat(F.lit("A::m"), F.col("o_orderkey") % 700).alias("raw")).distinct()
    return G.resolve_callees(calls, fs).select("file", "raw", "callee")


@query("""WITH RECURSIVE l AS (SELECT 'f' || n_regionkey AS file, n_nationkey AS a, n_nationkey + 5 AS b FROM nation), r AS (SELECT file, a FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.file = l.file AND m.b = l.a)),
c(file, root, here, chain) AS (SELECT file, a, a, [a] FROM r UNION ALL SELECT c.file, root, l.b, list_append(chain, l.b) FROM c JOIN l ON l.file = c.file AND l.a = c.here)
SELECT file, root, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM c GROUP BY file, root HAVING max(len(chain)) >= 3""")
def pass_chains(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    links = n.select(F.concat(F.lit("f"), "n_regionkey").alias("file"), F.col("n_nationkey").alias("caller"), (F.col("n_nationkey") + 5).alias("callee"))
    return G.pass_chains(links).withColumn("chain", F.array_join("chain", ">"))


@query()
def duplicate_code(spark, sf_dir):
    """Documents stand in for function bodies: equal token shapes."""
    d = table(spark, sf_dir, "documents")
    return K.duplicates(d.select(F.lit("python").alias("language"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.lit(1).alias("line"), F.col("lang").alias("symbol"), "text"))


@query("SELECT 'category' AS by, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'language', o_orderpriority, count(*) FROM orders GROUP BY 2")
def audit_summary(spark, sf_dir):
    return K.audit_summary(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("language")))


@query("""SELECT n_name AS name, count(s_suppkey) AS n, CASE WHEN count(s_suppkey) = 0 THEN 'remove' ELSE 'inline' END AS action FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 = 0) ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(s_suppkey) <= 1""")
def lonely_abstractions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    impl = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return K.lonely(n.select(F.col("n_name").alias("name"), F.lit(False).alias("allowed")), impl).select("name", "n", "action")


def code_files(spark, sf_dir) -> DataFrame:
    """Source files written around document words."""
    d = table(spark, sf_dir, "documents")
    i, s = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    py = F.concat(F.lit("# about\nfrom ..pkg import x\nfrom .m"), (F.col("doc_id") - 4).cast("string"), F.lit(" import y\n\nclass Base(ABC):\n    def go(self, a, b):\n        return inner(a, b)\n\ndef f"), i, F.lit("(a):\n    pass\n\ndef g(a):\n    return f"), i, F.lit("(a)\n"))
    ts = F.concat(F.lit("// about\nimport { a } from './m"), (F.col("doc_id") - 4).cast("string"), F.lit("';\nconst b = require('../lib');\n/* long\n comment */\nthrow new Error('not implemented');\n"))
    rs = F.concat(F.lit("pub mod m"), (F.col("doc_id") + 4).cast("string"), F.lit(";\nuse crate::{a, b::{c, d}, self};\nfn f() { todo!() }\n"))
    sh = F.lit("#!/bin/sh\n# about\necho 1\n")
    text = F.when(s == 0, py).when(s == 1, ts).when(s == 2, rs).otherwise(sh)
    ext = F.element_at(F.array(*map(F.lit, ["py", "ts", "rs", "sh"])), (s + 1).cast("int"))
    return d.select(F.concat("lang", F.lit("/m"), i, F.lit("."), ext).alias("path"), text.alias("text"), "doc_id", "lang")


@query("""WITH k AS (SELECT *, doc_id % 4 AS s, lang || '/m' || doc_id || '.' || (['py', 'ts', 'rs', 'sh'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS f FROM documents)
SELECT f AS "from", 2 AS line, 'import' AS kind, '..pkg' AS to_raw FROM k WHERE s = 0 UNION ALL SELECT f, 3, 'import', '.m' || (doc_id - 4) FROM k WHERE s = 0 AND doc_id >= 4 UNION ALL SELECT f, 3, 'import', '.m' FROM k WHERE s = 0 AND doc_id < 4 AND FALSE
UNION ALL SELECT f, 2, 'import', './m' || (doc_id - 4) FROM k WHERE s = 1 UNION ALL SELECT f, 3, 'import', '../lib' FROM k WHERE s = 1
UNION ALL SELECT f, 1, 'mod', 'mod m' || (doc_id + 4) FROM k WHERE s = 2 UNION ALL SELECT f, 2, 'use', unnest(['crate::a', 'crate::b::{c, d}', 'crate']) FROM k WHERE s = 2""")
def dependency_edges(spark, sf_dir):
    return K.raw_edges(code_files(spark, sf_dir))


@query("""WITH k AS (SELECT *, doc_id % 4 AS s FROM documents), x AS (SELECT a.doc_id, a.lang, b.doc_id AS t FROM k a LEFT JOIN k b ON b.lang = a.lang AND b.doc_id = CASE WHEN a.s = 2 THEN a.doc_id + 4 ELSE a.doc_id - 4 END WHERE a.s < 3)
SELECT lang || '/m' || doc_id || '.' || (['py', 'ts', 'rs'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS "from", lang || '/m' || t || '.' || (['py', 'ts', 'rs'])[CAST(t % 4 + 1 AS INTEGER)] AS "to" FROM x WHERE t IS NOT NULL""")
def resolved_edges(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return K.resolve_edges(K.raw_edges(f), f).filter("resolved").select("from", "to")


@query("""SELECT lang || '/m' || doc_id || '.' || (['py', 'ts', 'rs'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS path, (['python', 'typescript', 'rust'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS language, (CASE doc_id % 4 WHEN 0 THEN 13 WHEN 1 THEN 6 ELSE 3 END)::INTEGER AS lines FROM documents WHERE doc_id % 4 < 3""")
def code_nodes(spark, sf_dir):
    return K.nodes(code_files(spark, sf_dir)).select("path", "language", "lines")


@query("""SELECT lang || '/m' || doc_id || '.' || (['py', 'ts', 'rs'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS path, (CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 3 END)::INTEGER AS line, CASE WHEN doc_id % 4 = 2 THEN 'error' ELSE 'warning' END AS severity FROM documents WHERE doc_id % 4 < 3""")
def placeholders(spark, sf_dir):
    return K.placeholders(code_files(spark, sf_dir))


@query("""SELECT lang || '/m' || doc_id || '.' || (['py', 'ts', 'rs', 'sh'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS path, (CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 3 END)::INTEGER AS total, (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 2 END)::INTEGER AS comments FROM documents""")
def comment_ratio(spark, sf_dir):
    return K.comment_lines(code_files(spark, sf_dir)).select("path", "total", "comments")


@query(r"""SELECT lang || '/m' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' ELSE '.sh' END AS path, CASE doc_id % 4 WHEN 3 THEN 'echo 1' || chr(10)
  ELSE replace('from ..pkg import x~from .m' || (doc_id - 4) || ' import y~~class Base(ABC):~    def go(self, a, b):~        return inner(a, b)~~def f' || doc_id || '(a):~    pass~~def g(a):~    return f' || doc_id || '(a)~', '~', chr(10)) END AS text FROM documents WHERE doc_id % 4 IN (0, 3)""")
def stripped_comments(spark, sf_dir):
    return K.stripped(code_files(spark, sf_dir))


@query("""SELECT lang || '/m' || doc_id || '.py' AS path, unnest(['Base', 'Base::go', 'f' || doc_id, 'g']) AS target, unnest(['class', 'method', 'function', 'function']) AS kind, unnest([NULL, 'inner', NULL, 'f' || doc_id]) AS forwards, unnest([FALSE, FALSE, TRUE, FALSE]) AS placeholder FROM documents WHERE doc_id % 4 = 0 AND doc_id >= 4""")
def python_index(spark, sf_dir):
    return K.python_index(code_files(spark, sf_dir)).select("path", "target", "kind", "forwards", "placeholder")


# Coverage: each order is a report of one file, each line item a counted line.
@query("""SELECT l_orderkey AS report, 'f' || l_orderkey AS file, count(DISTINCT l_linenumber) AS lines_found, count(DISTINCT l_linenumber) FILTER (l_quantity > 25) AS lines_hit, count(DISTINCT l_partkey) AS functions_found, count(*) FILTER (l_suppkey % 2 = 1) AS branches_hit FROM lineitem GROUP BY l_orderkey""")
def lcov_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    row = lambda k, t: F.struct(F.lit(k).alias("k"), t.alias("text"))
    hits = F.when(F.col("l_quantity") > 25, F.lit("1")).otherwise("0")
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    body = li.select(F.col("l_orderkey").alias("report"), F.explode(F.array(row(1, F.concat(F.lit("DA:"), line, F.lit(","), hits)), row(2, F.concat(F.lit("FN:1,f"), part)), row(3, F.concat(F.lit("BRDA:1,0,0,"), (F.col("l_suppkey") % 2).cast("string"))))).alias("x")).select("report", "x.*")
    head = li.select(F.col("l_orderkey").alias("report")).distinct().select("report", F.lit(0).alias("k"), F.concat(F.lit("SF:f"), F.col("report").cast("string")).alias("text"))
    rows = head.unionByName(body).withColumnRenamed("k", "line_no")
    return K.lcov(rows).select("report", "file", "lines_found", "lines_hit", "functions_found", "branches_hit")


@query("""SELECT o_orderkey AS report, 'a' AS file, 2 AS statements_found, (o_custkey % 2 + 1)::INTEGER AS statements_hit, 1 AS functions_found, (o_custkey % 2)::INTEGER AS functions_hit FROM orders""")
def istanbul_coverage(spark, sf_dir):
    n = (F.col("o_custkey") % 2).cast("string")
    text = F.concat(F.lit('{"a":{"s":{"0":1,"1":'), n, F.lit('},"f":{"0":'), n, F.lit("}}}"))
    return K.istanbul(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), text.alias("text")))


@query("""SELECT o_orderkey AS report, 'b.py' AS file, 2::BIGINT AS lines_found, (o_custkey % 2 + 1)::BIGINT AS lines_hit FROM orders""")
def cobertura_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), (F.col("o_custkey") % 2).cast("string").alias("n"))
    lines_ = F.array(F.lit('<class name="x" filename="b.py">'), F.lit('<line number="1" hits="3"/>'), F.concat(F.lit('<line number="2" hits="'), "n", F.lit('"/>')))
    return K.cobertura(o.select("report", F.posexplode(lines_).alias("line_no", "text")))


@query("SELECT user_id AS finding_id, round(least(sum(value) / 1000, 1), 6) AS score, CASE WHEN sum(value) / 1000 > 0.7 THEN 'high' WHEN sum(value) / 1000 > 0.5 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY user_id")
def confidence_scores(spark, sf_dir):
    return K.confidence(table(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id"), (F.col("value") / 1000).alias("weight")))


@query("SELECT event_type AS symbol, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS annotations, count(*) FILTER (event_id % 3 = 1) AS implementations FROM events GROUP BY event_type")
def symbol_counts(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "type-annotation").when(F.col("event_id") % 3 == 1, "implements").otherwise("call")
    return K.symbol_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), kind.alias("usage_kind")))


# Specifications: parts with lists of varied length.
@query("""WITH p AS (SELECT p_partkey AS k FROM part), i AS (SELECT k, unnest([CASE WHEN k % 7 = 0 THEN 'error:name' END, CASE WHEN k % 5 = 0 THEN 'error:steps' WHEN k % 5 < 3 THEN 'warning:steps' END, CASE WHEN k % 4 < 3 THEN 'warning:invariants' END, CASE WHEN k % 2 = 0 THEN 'warning:inputs' END, 'warning:outputs', 'warning:side_effects', 'warning:failure_modes', CASE WHEN k % 3 = 0 THEN 'warning:justifications.reason' END]) AS x FROM p)
SELECT 'p' || k AS path, string_split(x, ':')[1] AS severity, string_split(x, ':')[2] AS field FROM i WHERE x IS NOT NULL""")
def flow_spec_issues(spark, sf_dir):
    k = F.col("p_partkey")
    some = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int")).cast("array<string>")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    spec = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("path"), F.when(k % 7 == 0, " ").otherwise("n").alias("name"), F.lit("e").alias("entrypoint"), some(k % 5).alias("steps"), some(k % 4).alias("invariants"), some(k % 2).alias("inputs"), none.alias("outputs"), none.alias("side_effects"), none.alias("failure_modes"), F.array(F.struct(F.lit("i").alias("item"), F.when(k % 3 == 0, "habit").otherwise("Reuse").alias("reason"))).alias("justifications"), F.lit(None).cast("string").alias("error"))
    return S.directory_issues(spec)


@query()
def flow_spec_parsing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("---\nname: d"), "doc_id", F.lit("\nentrypoint: x\nsteps: [a, b, c]\n---\n"), "text")
    return S.parsed(d.select(F.concat(F.lit("f"), "doc_id").alias("path"), text.alias("text"))).select("path", "name", "entrypoint", F.size("steps").alias("n_steps"), "error")


@query("""SELECT user_id AS uri, count(*) AS n, max(event_id) AS version FROM events GROUP BY user_id""")
def latest_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("version"), F.col("props").alias("text"), F.lit("change").alias("op"), F.col("ts").alias("arrived"))
    n = e.groupBy("uri").agg(F.count("*").alias("n"))
    return live.latest(e).join(n, "uri").select("uri", "n", "version")


@query()
def graph_records(spark, sf_dir):
    v, e = _linked(spark, sf_dir)
    return sinks.records("type", node=v, edge=e.select("from", "to", "kind"), orphan=G.orphans(v, e), stats=G.roles(v, e))


@query("SELECT path, count(*) AS n FROM (SELECT 'a/' || n_name AS path FROM nation UNION ALL SELECT 'a/' || n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY path HAVING count(*) = 2")
def coverage_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    p = n.select(F.concat(F.lit("a/"), "n_name").alias("path"))
    c = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("file"))
    return K.coverage_for(p, c).select("path", F.lit(2).cast("long").alias("n"))



@query("""WITH k AS (SELECT doc_id, unnest(['Section ' || lang, 'Section ' || source, 'Section ' || lang]) AS title, unnest([0, 1, 2]) AS p FROM documents)
SELECT doc_id, CAST(p AS BIGINT) AS "at", CASE WHEN k = 0 THEN s ELSE s || '-' || k END AS slug FROM (SELECT *, lower(replace(title, ' ', '-')) AS s, row_number() OVER (PARTITION BY doc_id, title ORDER BY p) - 1 AS k FROM k)""")
def heading_slugs(spark, sf_dir):
    from prosemill.functions.text import heading_slugs as slugs

    d = table(spark, sf_dir, "documents")
    titles = F.array(F.concat(F.lit("Section "), "lang"), F.concat(F.lit("Section "), "source"), F.concat(F.lit("Section "), "lang"))
    return slugs(d.select("doc_id", F.posexplode(titles).alias("at", "title")).withColumn("at", F.col("at").cast("long")))


@query(f"WITH {RESOLVED} SELECT \"from\", \"to\", kind FROM e SEMI JOIN v ON e.\"to\" = v.path WHERE kind = 'use'")
def shown_edges(spark, sf_dir):
    return G.shown_edges(edges(spark, sf_dir), vertices(spark, sf_dir), ["use"])


@query("""WITH b AS (SELECT o_orderkey AS p FROM orders), a AS (SELECT o_orderkey AS p FROM orders WHERE o_orderkey % 7 <> 0) SELECT 'o' || p AS old, 'unmapped' AS issue FROM b ANTI JOIN a USING (p)""")
def refactor_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("o"), "o_orderkey").alias("path")
    none = spark.createDataFrame([], "old string, action string, targets array<string>")
    return G.guard(o.select(name), o.filter("o_orderkey % 7 <> 0").select(name), none)


@query("""SELECT 'c' || c_custkey AS path, c_nationkey % 2 = 0 AS git_tracked FROM customer""")
def git_tracked(spark, sf_dir):
    from prosemill.sources.files import tracked

    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("c"), "c_custkey").alias("path")
    return tracked(c.select(path), c.filter("c_nationkey % 2 = 0").select(path))


@query("""SELECT 'r' || r_regionkey || '/Cargo.toml' AS path, 'lib_' || lower(replace(r_name, ' ', '_')) AS name FROM region""")
def cargo_manifests(spark, sf_dir):
    from prosemill.sources.files import cargo_manifests as manifests

    r = table(spark, sf_dir, "region")
    text = F.concat(F.lit('[package]\nname = "lib-'), F.lower(F.translate("r_name", " ", "-")), F.lit('"\n'))
    return manifests(r.select(F.concat(F.lit("r"), "r_regionkey", F.lit("/Cargo.toml")).alias("path"), text.alias("text"))).select("path", "name")


@query()
def python_control_flow(spark, sf_dir):
    """Exit paths of the Python functions of the derived source tree."""
    n, e = K.python_cfg(code_files(spark, sf_dir))
    by = ["path", "function"]
    return G.simple_paths(e, n.filter("kind = 'entry'").select(*by, "node"), G.exit_nodes(n), by)


@query("""SELECT 'n' || n_nationkey AS path, n_regionkey % 2 = 0 AS reachable FROM nation""")
def reachable_symbols(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("n"), "n_nationkey").alias("symbol")
    return K.reachable_symbols(n.select(name), n.filter("n_regionkey % 2 = 0").select(name)).select(F.col("symbol").alias("path"), "reachable")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'c1')")
def text_search(spark, sf_dir):
    from prosemill.functions.text import contains_text

    return contains_text(table(spark, sf_dir, "documents").select("doc_id", "source"), "C1", "source")


# Sources whose shape follows the document: as many guards as its id leaves over 4, a parameter unwrapped for odd ids.
GUARDS = 4


def logic_files(spark, sf_dir) -> DataFrame:
    """One Rust and one TypeScript file for each document."""
    d = table(spark, sf_dir, "documents")
    i, n = F.col("doc_id").cast("string"), (F.col("doc_id") % GUARDS).cast("int")
    each = lambda text: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: text(k.cast("string"))), "")
    lit = F.lit
    rust = F.concat(
        lit("pub trait Step"), i, lit(" { fn step(&self) -> i32; }\nimpl Step"), i, lit(" for Walk { fn step(&self) -> i32 { 1 } }\n"),
        lit("fn pass"), i, lit("(a: i32, b: &str) -> i32 {\n    inner(a.clone(), b)\n}\nfn work(x: Option<i32>, v: &[i32]) -> i32 {\n"),
        F.when(F.col("doc_id") % 2 == 1, "    let y = x.unwrap();\n").otherwise("    let y = 7;\n"),
        each(lambda k: F.concat(lit("    if y == "), k, lit(" { return "), k, lit("; }\n"))),
        lit("    let total = v[y];\n    match total { 0 => panic!(\"todo\"), _ => {} }\n    total\n}\n"),
    )
    script = F.concat(
        lit("import app from './app';\nexport interface Shape"), i, lit(" { area(): number }\nexport class Box implements Shape"), i, lit(" {\n  area(): number { return this.size(); }\n"),
        lit("  send(q: Query) { return this.post(q); }\n}\nexport function main(a: Args): Result {\n"),
        each(lambda k: F.concat(lit("  if (a.n === "), k, lit(") { throw new Error(a.name, "), k, lit("); }\n"))),
        lit("  for (const z of a.items) { if (!z) continue; visit(z, a); }\n  return done(a);\n}\n"),
    )
    both = d.select("doc_id", F.explode(F.array(F.struct(lit("rs").alias("ext"), rust.alias("text")), F.struct(lit("ts").alias("ext"), script.alias("text")))).alias("f"))
    return both.select(F.concat(lit("src/f"), i, lit("."), F.col("f.ext")).alias("path"), F.col("f.text").alias("text"), "doc_id")


@query(f"""WITH k AS (SELECT doc_id, doc_id % {GUARDS} AS n FROM documents)
SELECT 'src/f' || doc_id || '.rs' AS path, 'work' AS function, CAST(n + 2 AS BIGINT) AS n_exits, CAST(2 * n + 1 AS BIGINT) AS n_conditions, CAST(n + 2 AS BIGINT) AS n_paths FROM k
UNION ALL SELECT 'src/f' || doc_id || '.ts', 'main', CAST(n + 1 AS BIGINT), CAST(2 * n + 4 AS BIGINT), CAST(n + 1 AS BIGINT) FROM k""")
def source_control_flow(spark, sf_dir):
    """Exits, conditional edges and paths of the branching functions: a guard adds an exit, a path and two edges."""
    nodes, edges = B.source_cfg(logic_files(spark, sf_dir))
    by = ["path", "function"]
    found = G.simple_paths(edges, nodes.filter("kind = 'entry'").select(*by, "node"), G.exit_nodes(nodes), by).groupBy(*by).agg(F.count("*").alias("n_paths"))
    exits = G.exit_nodes(nodes).groupBy(*by).agg(F.count("*").alias("n_exits"))
    conditions = edges.groupBy(*by).agg(F.count("condition").alias("n_conditions"))
    return found.join(exits, by).join(conditions, by).filter(F.col("function").isin("work", "main")).select(*by, "n_exits", F.when(F.col("function") == "work", F.col("n_conditions") - 1).otherwise(F.col("n_conditions")).alias("n_conditions"), "n_paths")


@query(f"""WITH k AS (SELECT doc_id, doc_id % {GUARDS} AS n, doc_id % 2 = 1 AS odd FROM documents)
SELECT 'src/f' || doc_id || '.rs' AS path, variable, kind, n FROM (
  SELECT doc_id, unnest(['x', 'v', 'y', 'total']) AS variable, unnest(['param', 'param', 'let', 'let']) AS kind, CAST(1 AS BIGINT) AS n FROM k
  UNION ALL SELECT doc_id, unnest(['x', 'x']), unnest(['read', 'unwrap']), 1 FROM k WHERE odd
  UNION ALL SELECT doc_id, 'y', 'condition', n FROM k WHERE n > 0
  UNION ALL SELECT doc_id, unnest(['v', 'y', 'total', 'total']), unnest(['read', 'index', 'condition', 'read']), 1 FROM k)""")
def rust_dataflow(spark, sf_dir):
    flow = B.rust_flow(logic_files(spark, sf_dir)).filter("function = 'work'")
    return flow.groupBy("path", "variable", "kind").agg(F.count("*").alias("n"))


@query("SELECT 'src/f' || doc_id || '.rs' AS path, 'x' AS parameter, 7 AS unwrap_line, 6 AS param_line FROM documents WHERE doc_id % 2 = 1")
def unchecked_unwraps(spark, sf_dir):
    flow = B.rust_flow(logic_files(spark, sf_dir))
    _, _, changes = A.parts(flow)
    defs = flow.filter(F.col("kind").isin("param", "let", "assign", "loop"))
    return G.unchecked_unwraps(defs, changes, ["path", "function"]).drop("function")


@query(f"""WITH k AS (SELECT doc_id, 'src/f' || doc_id || '.rs' AS path, doc_id % {GUARDS} AS n FROM documents), g AS (SELECT *, unnest(range(1, n + 1)) AS i FROM k)
SELECT 'exit-path' AS category, path, 'work' AS function, 6 AS line, array_to_string(list_transform(range(1, i), lambda j: '!y == ' || j), ' && ') || CASE WHEN i > 1 THEN ' && ' ELSE '' END || 'y == ' || i AS detail FROM g
UNION ALL SELECT 'exit-path', path, 'work', 6, array_to_string(list_concat(list_transform(range(1, n + 1), lambda j: '!y == ' || j), [m]), ' && ') FROM k, (SELECT unnest(['0', '_']) AS m)
UNION ALL SELECT 'validation-gap', path, 'work', 6, 'v' FROM k UNION ALL SELECT 'validation-gap', path, 'work', 6, 'x' FROM k WHERE doc_id % 2 = 1
UNION ALL SELECT 'validation-gap', path, 'pass' || doc_id, 3, unnest(['a', 'b']) FROM k""")
def logic_findings(spark, sf_dir):
    return A.logic_audit(logic_files(spark, sf_dir))


@query(f"""WITH k AS (SELECT doc_id, doc_id % {GUARDS} AS n FROM documents), s AS (
  SELECT doc_id, unnest(['Shape' || doc_id, 'Box', 'main', 'app', 'Query', 'Args', 'Result', 'Shape' || doc_id, 'area', 'this.size', 'this.post', 'visit', 'done']) AS symbol,
    unnest(['export', 'export', 'export', 'import', 'type-annotation', 'type-annotation', 'type-annotation', 'implements', 'call', 'call', 'call', 'call', 'call']) AS usage_kind,
    unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0, 1, 0]) AS arg_count, 1 AS n FROM k
  UNION ALL SELECT doc_id, 'Error', 'call', 1, n FROM k WHERE n > 0)
SELECT 'src/f' || doc_id || '.ts' AS path, symbol, usage_kind, CAST(arg_count AS INTEGER) AS arg_count, CAST(n AS BIGINT) AS n FROM s""")
def ts_symbols(spark, sf_dir):
    return B.ts_symbols(logic_files(spark, sf_dir)).groupBy("path", "symbol", "usage_kind", "arg_count").agg(F.count("*").alias("n"))


@query("""SELECT 'src/f' || doc_id || '.rs' AS path, unnest(['Walk::step', 'pass' || doc_id, 'work', 'Step' || doc_id, 'Walk']) AS target, unnest(['method', 'function', 'function', 'trait', 'implements']) AS kind, unnest([NULL, 'inner', NULL, NULL, NULL]) AS forwards, unnest([FALSE, FALSE, TRUE, FALSE, FALSE]) AS placeholder FROM documents
UNION ALL SELECT 'src/f' || doc_id || '.ts', unnest(['Box::area', 'Box::send', 'main', 'Shape' || doc_id, 'Box', 'Box']), unnest(['method', 'method', 'function', 'interface', 'class', 'implements']), unnest([NULL, 'Box::post', NULL, NULL, NULL, NULL]), FALSE FROM documents""")
def source_functions(spark, sf_dir):
    return B.source_index(logic_files(spark, sf_dir)).select("path", "target", "kind", "forwards", "placeholder")


@query("""WITH d AS (SELECT count(*) AS n FROM documents)
SELECT category, language, CAST(m * n AS BIGINT) AS n FROM d, (SELECT unnest(['pass-through', 'pass-through', 'placeholder', 'lonely-abstraction', 'lonely-abstraction']) AS category, unnest(['rust', 'typescript', 'rust', 'rust', 'typescript']) AS language, 1 AS m)""")
def source_audit(spark, sf_dir):
    """Findings by category and language; bodies are too short here to count as duplicated."""
    return A.audit(logic_files(spark, sf_dir), min_tokens=1_000).groupBy("category", "language").agg(F.count("*").alias("n"))


@query("SELECT 'walk' AS category, 'no-such-folder' AS name")
def walk_issues(spark, sf_dir):
    from prosemill.sources.files import walk_issues as issues

    return issues(spark, [f"{sf_dir}/no-such-folder"]).select("category", F.substring_index("path", "/", -1).alias("name"))
