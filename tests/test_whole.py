"""Queries over small tables against brute force: every row takes part."""

import duckdb
import pytest
from pyspark.sql import functions as F

from prosemill.operators import code as K
from prosemill.operators import graph as G
from prosemill.operators.prose import findings
from prosemill.plans import prose_queries as P
from prosemill.plans import structure_queries as Q
from prosemill.plans.catalog import ORACLES, QUERIES


def stored(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_part_graph_has_all_parts(spark, tmp_path):
    lines = [(p, p % 4 + 1 + k, "RNA"[(p + k) % 3]) for p in range(1, 12) for k in (0, 0, 3)]
    d = stored(spark, tmp_path, lineitem=(lines, "l_partkey long, l_suppkey long, l_returnflag string"), part=([(p,) for p in range(1, 14)], "p_partkey long"), supplier=([(s,) for s in range(1, 8)], "s_suppkey long"))
    nodes = {f"p{p}" for p in range(1, 14)} | {f"s{s}" for s in range(1, 8) if s % 4}
    edges = {(f"p{p}", f"s{s}", "use" if f == "R" else "import") for p, s, f in lines}
    known = [e for e in edges if e[1] in nodes]
    want = {n: (sum(e[1] == n for e in known), sum(e[0] == n for e in known)) for n in nodes}
    assert {r["path"]: (r["n_in"], r["n_out"]) for r in Q.degrees(spark, d).collect()} == want
    assert {r["kind"]: (r["n"], r["n_resolved"]) for r in Q.edge_stats(spark, d).collect()} == {k: (sum(e[2] == k for e in edges), sum(e[2] == k for e in known)) for k in ("use", "import")}
    roles = Q.roles(spark, d).first()
    assert (roles["orphans"], roles["sources"]) == (sum(v == (0, 0) for v in want.values()), sum(o > 0 for _, o in want.values()))
    assert {(r["from"], r["to"]) for r in Q.shown_edges(spark, d).collect()} == {e[:2] for e in known if e[2] == "use"}


def test_order_graph_has_all_orders(spark, tmp_path):
    orders = [(1000 + i, i + (1000 if i % 7 else 0)) for i in range(60)] + [(9, 700), (700, 701), (701, 1400)]
    d = stored(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long"))
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for o, c in orders:
        a, b = root(f"n{o}"), root(f"n{c}")
        above[max(a, b)] = min(a, b)
    assert {r["path"]: r["component"] for r in Q.graph_components(spark, d).collect()} == {n: root(n) for n in list(above)}


def test_heading_rules_on_documents_with_headings(spark, tmp_path):
    texts = [None, "", "Plain words here.", "# goal\n\nText one. Text two.\n\n# more?\n\n- item", "# misc\n\nText.\n\n##### deeper\n\nText.", "1. a\n2. b"]
    d = stored(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    want = dict.fromkeys(["D19a", "D19b", "D19c", "D19e", "D19f", "D19g", "D19h", "D26"], len(texts))
    for t in texts:
        heads = [x for x in (t or "").split("\n") if x.startswith("#")]
        want["D19a"] += sum(x.startswith("####") for x in heads)
        want["D19b"] += sum(x.endswith("?") for x in heads)
        want["D19g"] -= "# goal" in heads
        want["D19h"] += "# misc" in heads
    assert {r["detector"]: r["n"] for r in P.heading_rules(spark, d).collect()} == want


def test_thin_sections_of_documents_with_headings(spark, tmp_path):
    long = "One two. " * 25
    texts = [None, "", long, f"Short.\n\n# next\n\n{long}", "One.\n\n# a\n\nTwo.\n\n# b", "- x\n" * 30, "One. Two. Three."]
    d = stored(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["thin"] for r in P.thin_sections(spark, d).collect()} == {0: 1, 1: 1, 3: 1, 4: 3, 5: 1, 6: 1}


def test_stripped_comments_has_python_files(spark, tmp_path):
    d = stored(spark, tmp_path, documents=([(i, "en") for i in range(8)], "doc_id long, lang string"))
    got = {r["path"]: r["text"] for r in Q.stripped_comments(spark, d).collect()}
    assert set(got) == {"en/m0.py", "en/m3.sh", "en/m4.py", "en/m7.sh"}
    assert got["en/m3.sh"] == "echo 1\n"
    assert got["en/m4.py"] == "from ..pkg import x\nfrom .m0 import y\n\nclass Base(ABC):\n    def go(self, a, b):\n        return inner(a, b)\n\ndef f4(a):\n    pass\n\ndef g(a):\n    return f4(a)\n"


def test_pass_chains_has_all_nations(spark, tmp_path):
    d = stored(spark, tmp_path, nation=([(k, k % 5) for k in range(25)], "n_nationkey long, n_regionkey long"))
    assert {r["chain"] for r in Q.pass_chains(spark, d).collect()} == {">".join(str(k) for k in range(r, 30, 5)) for r in range(5)}


def test_paths_of_many_guards(spark):
    guards = 33
    text = "def f(x):\n" + "".join(f"    if x == {i}:\n        return {i}\n" for i in range(guards)) + "    return x\n"
    n, e = K.python_cfg(spark.createDataFrame([("a.py", text)], "path string, text string"))
    by = ["path", "function"]
    found = G.simple_paths(e, n.filter("kind = 'entry'").select(*by, "node"), G.exit_nodes(n), by).collect()
    longest = [r for r in found if r["conditions"] == [f"!x == {i}" for i in range(guards)]]
    assert len(found) == guards + 1 and len(longest) == 1 and len(longest[0]["steps"]) > 64


@pytest.mark.parametrize("query", ["cfg_dead_branches", "cfg_paths", "cfg_reachable", "cfg_stats"])
def test_repeated_lines_take_the_first_row(spark, tmp_path, query):
    """Rows of one order and line stand in files and splits that Spark reads in another order than the table's."""
    import random

    random.seed(7)
    rows = [(random.randrange(120), random.randrange(1, 8), float(random.randrange(1, 51)), random.choice("FO")) for _ in range(3000)]
    for k, (a, b) in enumerate([(0, 200), (200, 1100), (1100, 3000)]):  # Spark takes the largest file first
        stored(spark, tmp_path / "x", **{f"part-{k}": (rows[a:b], "l_orderkey long, l_linenumber int, l_quantity double, l_linestatus string")})
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(3):
        next((tmp_path / f"x/part-{k}.parquet").glob("part-*.parquet")).rename(tmp_path / f"lineitem.parquet/part-{k}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES[query]).fetchall())
    assert want and sorted(tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect()) == want


def agrees_on_lines(spark, path, query, rows):
    """A query over some lines, and its SQL; of an order and line there is one row at most."""
    d = stored(spark, path, lineitem=(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_linestatus string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM read_parquet('{d}/lineitem.parquet/*.parquet')")
    want = con.execute(ORACLES[query]).fetchall()
    assert want and set(map(tuple, (got := QUERIES[query](spark, d).collect()))) == set(want) and len(got) == len(want)


def test_paths_end_at_lines_without_a_status(spark, tmp_path):
    rows = [(1, 1, 5.0, None), (1, 2, 5.0, "F"), (2, 1, 5.0, "O"), (2, 2, 5.0, None), (2, 3, 5.0, "F"), (3, 1, 30.0, "F"), (3, 2, 5.0, None), (3, 3, None, "O"), (3, 4, 5.0, "F"), (None, 1, 5.0, "O"), (None, 2, 5.0, "F")]
    agrees_on_lines(spark, tmp_path, "cfg_paths", rows)


def test_stats_of_lines_without_order_or_number(spark, tmp_path):
    rows = [(None, 1, 5.0, "O"), (None, 2, 5.0, "F"), (1, None, 5.0, "F"), (1, 2, 30.0, "F"), (2, 1, None, "F"), (3, 4, 5.0, None)]
    agrees_on_lines(spark, tmp_path, "cfg_stats", rows)


def test_components_and_reach_by_rounds(spark, monkeypatch):
    """The ways beyond the bounds give what the ways within them give."""
    import random

    random.seed(4)
    e = [(f"n{random.randrange(300)}", f"n{random.randrange(300)}") for _ in range(170)] + [(f"c{k}", f"c{k + 1}") for k in range(30)]
    edges = spark.createDataFrame(e, "from string, to string")
    nodes = edges.select(F.explode(F.array("from", "to")).alias("path")).distinct().union(spark.createDataFrame([("alone",)], "path string"))
    within = {r["path"]: r["component"] for r in G.components(nodes, edges).collect()}
    parent = {x: x for pair in e for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        parent[find(a)] = find(b)
    least = {}
    for x in parent:
        least[find(x)] = min(x, least.get(find(x), x))
    assert within == {x: least[find(x)] for x in parent} | {"alone": "alone"}
    own = edges.withColumn("fn", F.when(F.col("from").startswith("c"), 1).otherwise(2))
    starts = spark.createDataFrame([(1, "c25"), (2, e[0][0]), (3, "lost")], "fn int, node string")
    near = {tuple(r) for r in G.reachable(own, starts, ["fn"]).collect()}
    monkeypatch.setattr(G, "LOCAL", 20)
    monkeypatch.setattr(G, "MANY", 10)
    assert {r["path"]: r["component"] for r in G.components(nodes, edges).collect()} == within
    far = {tuple(r) for r in G.reachable(own, starts, ["fn"]).collect()}
    assert near == far and (1, "c30") in near and (3, "lost") in near and (1, "c4") not in near


def test_running_and_places_in_blocks(spark, monkeypatch):
    from prosemill.functions import text as X

    monkeypatch.setattr(X, "RUN_BLOCK", 4)
    xs = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    d = spark.createDataFrame([(xs, "x" * 40), ([], ""), ([7], "y" * 8)], "xs array<bigint>, text string")
    d = X.add_running(X.add_running(d, {"total": "xs"}), {"most": "xs"}, most=True)
    d = X.add_hops(d).withColumn("found", F.transform(F.sequence(F.lit(0), F.lit(50)), lambda at: X.last_before("total", at)))
    for r in d.collect():
        own = r["xs"]
        assert r["total"] == [sum(own[: k + 1]) for k in range(len(own))] and r["most"] == [max(own[: k + 1]) for k in range(len(own))]
        assert r["found"] == [sum(t <= at for t in r["total"]) - 1 for at in range(51)]


SHOUTED = ["WE ARES HERE. THAT'S THATED, THATLY SAID.", "Ares aRED AREING; arely, ARESX", "THATS, thates ThatD [1]", "That that. THATING? xTHAT", "ARE ARE"]


def agrees(spark, path, query, texts):
    """A query over some texts, and its SQL."""
    d = stored(spark, path, documents=([(i, t, "en", f"src{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES[query])
    columns = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert want and sorted(tuple(r[c] for c in columns) for r in QUERIES[query](spark, d).collect()) == want


def test_calls_to_action_with_upper_case_suffixes(spark, tmp_path):
    agrees(spark, tmp_path, "call_to_action", SHOUTED)


def test_weasels_with_upper_case_suffixes(spark, tmp_path):
    agrees(spark, tmp_path, "weasel", SHOUTED)


def test_ranges_in_any_case_are_found_and_disarmed(spark, tmp_path):
    texts = ["From here to there to nowhere.", "FROM a to b to c, from d to e to f", "frfrom x to y to z", "frfromom x to y to z", None, ""]
    agrees(spark, tmp_path, "exaggerated_ranges", texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["snippet"] for r in findings(docs, detectors=["D7"]).collect()) == ["FROM a to b to c", "From here to there to nowhere", "from d to e to f", "from x to y to z"]
