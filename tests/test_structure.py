"""Repository, graph, code, coverage, specification and streaming operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from prosemill import config as C
from prosemill.functions import text as X
from prosemill.operators import code as K
from prosemill.operators import flowspec as S
from prosemill.operators import graph as G
from prosemill.operators import repo as R
from prosemill.plans import lint as L
from prosemill.sources import files as files_source
from prosemill.sources import sinks
from prosemill.streaming import live


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_sentences(spark):
    cases = {
        "": [],
        "One. Two! Three? Four": ["One.", "Two!", "Three?", "Four"],
        "# Head\nBody text\nmore\n\nNext": ["# Head", "Body text\nmore", "Next"],
        "1. Item": ["1.", "Item"],
        "- a\n- b\nc": ["- a", "- b", "c"],
        "v1.2 is out.\n": ["v1.2 is out."],
    }
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: [s["s"] for s in r["sents"]] for r in X.add_sentences(d).collect()}
    assert got == {i: v for i, v in enumerate(cases.values())}


def test_scalars(spark):
    d = spark.createDataFrame([("a b 1 2c", "x y", "Big Title here")], "t string, s string, h string")
    r = d.select(X.word_count(F.col("t")).alias("w"), X.token_count(F.col("t")).alias("k"), X.title_case(F.col("h")).alias("h"), X.normalized(F.lit("  Ça VA, oui!  ok")).alias("n"), X.density(F.lit(2), F.lit(0)).alias("d"), X.canonical_stem(F.lit("deploy-final")).alias("c"), X.canonical_stem(F.lit("foo-newton")).alias("q"), X.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"), X.numbered(F.lit("3.14")).alias("m"), X.utf16_column_of(F.lit("é\U0001f600x"), F.lit(6)).alias("u")).first()
    assert (r["w"], r["k"], r["h"], r["n"], r["d"], r["c"], r["q"], r["j"], r["m"], r["u"]) == (3, 4, True, "Ça va oui ok", 2.0, "deploy", "foo", 0.5, True, 3)


def test_profiles():
    base = C.Profile("base", ("docs/**",), None, C.Rules(max_sentence_length=10, broad_terms=("Thing",)))
    child = C.Profile("child", (), "base", C.Rules(broad_terms=("Stuff",)))
    rules = C.Config(profiles=(base, child)).resolved("child")
    assert rules.max_sentence_length == 10 and rules.broad_terms[-2:] == ("thing", "stuff") and rules.max_heading_depth == 3
    with pytest.raises(ValueError):
        C.Config(profiles=(C.Profile("a", (), "b"), C.Profile("b", (), "a"))).resolved("a")
    assert C.category("CTA") == "call-to-action" and C.category("nonsense") is None
    assert C.overridden(C.Config(), {"limits.em_dashes_per_paragraph": "4", "x": "1"}).em_dashes == 4


def test_globs(spark):
    cases = [("docs/**", "docs/a/b.md", True), ("**/*.md", "a.md", True), ("**/*copy*", "x/a copy.txt", True), ("*.py", "a/b.py", True), ("a?.md", "ab.md", True), ("{x,y}/*.ts", "y/a.ts", True), ("docs/**", "src/a", False)]
    d = spark.createDataFrame(cases, "g string, p string, ok boolean")
    for g, p, ok in cases:
        assert d.select(R.matches(F.lit(p), (g,)).alias("m")).first()["m"] is ok, (g, p)


def test_organizer_names(spark):
    d = spark.createDataFrame([("file_v1.py",), ("file_v2.txt",), ("script_old.sh",), ("backup.bak",), ("normal_file.py",)], "n string")
    assert [r["x"] for r in d.select(R.legacy(F.col("n")).alias("x")).collect()] == [True] * 4 + [False]
    assert spark.range(1).select(R.output_prefix(F.lit("poc/output/results.json")).alias("x")).first()["x"] == "poc/output"


def test_repo_issues(spark):
    paths = [("deploy.sh", 1), ("deploy-final.sh", 1), ("a/__pycache__/x.pyc", 1), ("p/package-lock.json", 1), ("p/yarn.lock", 1), ("big.json", 600 * 1024), ("ai-notes.md", 1), ("README.md", 1)]
    found = rows(R.issues(spark.createDataFrame(paths, "path string, size_bytes long")), "category", "path")
    assert ("banned-dir", "a/__pycache__") in found and ("lockfile", "p") in found and ("large-json", "big.json") in found and ("stray-markdown", "ai-notes.md") in found
    assert ("dup-variants", "deploy-final.sh, deploy.sh") in found and ("slop", "deploy-final.sh") in found
    assert not [f for f in found if f[1] == "README.md"]


def test_workspace_edges(spark):
    fs = spark.createDataFrame([("core/src/lib.rs", "pub mod cfg;\npub use cfg::Thing;\n"), ("core/src/cfg.rs", "pub struct Thing;\n"), ("cli/src/main.rs", "use demo_core::cfg::Thing;\nfn main() {}\n"), ("web/a.ts", "import { x } from './b';\nimport './c.css';\nconst z = require('../web/b');\n"), ("web/b.ts", ""), ("pkg/m.py", "from .n import a\nfrom . import b\n"), ("pkg/n.py", ""), ("pkg/__init__.py", "")], "path string, text string")
    raw = K.raw_edges(fs)
    got = rows(K.resolve_edges(raw, fs).filter("resolved"), "from", "to")
    assert got == [("core/src/lib.rs", "core/src/cfg.rs"), ("pkg/m.py", "pkg/__init__.py"), ("pkg/m.py", "pkg/n.py"), ("web/a.ts", "web/b.ts"), ("web/a.ts", "web/b.ts")]
    crates = spark.createDataFrame([("demo_core", "core/src/lib.rs", "core/src")], "name string, root string, src string")
    assert rows(K.crate_uses(raw, fs, crates).filter("resolved"), "from", "to") == [("cli/src/main.rs", "core/src/cfg.rs")]


def test_cfg(spark):
    n = spark.createDataFrame([(1, 0, "entry", 1, 0), (1, 1, "branch", 2, 1), (1, 2, "return", 3, 1), (1, 3, "return", 4, 1), (1, 4, "block", 9, 1)], "fn int, node int, kind string, line int, n_statements int")
    e = spark.createDataFrame([(1, 0, 1, "next", None), (1, 1, 2, "true-branch", "x > 0"), (1, 1, 3, "false-branch", "x > 0")], "fn int, from int, to int, kind string, condition string")
    start = n.filter("kind = 'entry'").select("fn", "node")
    paths = rows(G.simple_paths(e, start, G.exit_nodes(n), ["fn"]), "steps", "conditions")
    assert paths == [([0, 1, 2], ["x > 0"]), ([0, 1, 3], ["!x > 0"])]
    assert rows(G.dead_branches(n, e, start, ["fn"]), "node") == [4]
    assert "flowchart TD" in sinks.mermaid(n, e, ["fn"]).first()["mermaid"]


def test_dataflow(spark):
    d = spark.createDataFrame([("f", "x", 1, "param", 0)], "fn string, variable string, line int, kind string, ord long")
    u = spark.createDataFrame([("f", "x", 2, "read", "warning_count"), ("f", "x", 3, "read", "error_count")], "fn string, variable string, line int, kind string, context string")
    assert rows(G.flows(d, u, ["fn"]), "line", "def_line") == [(2, 1), (3, 1)]
    assert G.escalations(u, ["fn"]).count() == 1


def test_components_and_mapping(spark):
    v = spark.createDataFrame([(x,) for x in "abcdef"], "path string")
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("e", "f")], "from string, to string")
    assert rows(G.components(v, e), "path", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")]
    assert rows(G.orphans(v, e), "path") == ["b", "d", "e"]


def test_callees(spark):
    f = spark.createDataFrame([("a.py", "1", "run"), ("b.py", "2", "T::run"), ("b.py", "3", "solo")], "file string, id string, target string")
    c = spark.createDataFrame([("a.py", "m", "run"), ("a.py", "m", "x::T::run"), ("a.py", "m", "y::solo"), ("a.py", "m", "none")], "file string, caller string, raw string")
    assert {r["raw"]: r["callee"] for r in G.resolve_callees(c, f).collect()} == {"none": None, "run": "1", "x::T::run": "2", "y::solo": "3"}


def test_python_index(spark):
    text = "class A(Base):\n    def go(self, x):\n        return other(x)\n\ndef todo():\n    pass\n"
    got = {r["target"]: r for r in K.python_index(spark.createDataFrame([("a.py", text), ("bad.py", "def ("), ("n.py", None)], "path string, text string")).collect()}
    assert set(got) == {"A", "A::go", "todo"} and got["A::go"]["forwards"] == "other" and got["todo"]["placeholder"] and got["A"]["bases"] == ["Base"]


def test_duplicates(spark):
    body = "def f(a):\n" + "\n".join(f"    x = a + {i}" for i in range(30))
    d = spark.createDataFrame([("python", f"p{i}.py", 1, "f", body.replace("x", f"y{i}")) for i in range(14)] + [("python", "z.py", 1, "g", "pass")], "language string, path string, line int, symbol string, text string")
    r = K.duplicates(d).collect()
    assert len(r) == 1 and r[0]["n"] == 14 and len(r[0]["evidence"]) == 13 and r[0]["evidence"][-1] == "... and 2 more"


def test_coverage(spark):
    text = "SF:a.rs\nDA:1,5\nDA:2,1\nDA:3,0\nFN:1,main\nFNDA:5,main\nend_of_record\n".split("\n")
    r = K.lcov(spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "report string, line_no int, text string")).first()
    assert (r["file"], r["lines_found"], r["lines_hit"], r["functions_hit"]) == ("a.rs", 3, 2, 1)
    assert spark.range(1).select(K.percent(F.lit(3), F.lit(5)).alias("p")).first()["p"] == 60.0
    names = spark.createDataFrame([("lcov.info",), ("coverage-final.json",), ("cobertura.xml",)], "p string")
    assert [x["f"] for x in names.select(K.coverage_format(F.col("p")).alias("f")).collect()] == ["lcov", "istanbul", "cobertura"]
    assert K.confidence(spark.createDataFrame([("a", 0.3), ("a", 0.2)], "finding_id string, weight double")).first()["level"] == "low"


def test_flow_specs(spark):
    good = S.template("x", "main").replace("TODO", "ok")
    fs = spark.createDataFrame([("a.md", good), ("b.md", "---\n: [\n---\n")], "path string, text string")
    got = rows(S.directory_issues(S.parsed(fs)), "path", "severity", "field")
    assert ("b.md", "error", "parse") in got and not [g for g in got if g[:2] == ("a.md", "error")]
    none = S.directory_issues(S.parsed(fs.filter("false"))).collect()
    assert [(r["severity"], r["field"]) for r in none] == [("warning", "specs")]


def test_files_and_records(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes(b"ok \xff")
    (tmp_path / "b.md").write_text("x")
    got = files_source.tree(spark, str(tmp_path), glob="*.md")
    assert rows(got, "path") == ["b.md", "d/a.md"]
    assert rows(files_source.tree(spark, str(tmp_path), ignore=("d/**",), content=False), "path") == ["b.md"]
    out = str(tmp_path / "out")
    sinks.write_jsonl(sinks.records("type", node=got.select("path"), stats=got.agg(F.count("*").alias("n"))), out)
    assert spark.read.json(out).groupBy("type").count().count() == 2


def test_reports(spark):
    d = spark.createDataFrame([(1, "We will leverage it."), (2, "Fine."), (3, None)], "doc_id long, text string")
    found = L.lint(d)
    r = {x["doc_id"]: x for x in L.document_reports(d, found).collect()}
    assert r[1]["verdict"] == "fail" and r[2]["verdict"] == "ok" and r[3]["n_findings"] == 0
    assert sinks.exit_status(L.document_reports(d, found)).first()["status"] == 1
    assert L.selected(found, only=["buzzword"]).count() == 1 and L.selected(found, disable=["buzzword"]).count() == 0
    assert L.run_report(L.document_reports(d, found)).first()["n_documents"] == 3


def test_stream_equals_batch(spark, tmp_path):
    schema = "uri string, version long, text string, op string, arrived long"
    events = spark.createDataFrame([("a", 1, "We leverage it.", "open", 1), ("a", 2, "Fine.", "change", 2), ("b", 1, "We leverage it.", "open", 3), ("c", 1, "We leverage it.", "open", 4), ("c", 2, "", "close", 5), ("agents.md", 1, "We leverage it.", "open", 6)], schema)
    source = str(tmp_path / "in")
    events.coalesce(1).write.json(source)
    got = []
    q = live.watch(spark.readStream.schema(schema).json(source), lambda df, n: got.extend(df.collect()), checkpoint=str(tmp_path / "state"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["uri"], r["n_findings"]) for r in got) == [("a", 0), ("b", 1), ("c", 0)] == sorted((r["uri"], r["n_findings"]) for r in live.changes(events).collect())


def test_partitions_do_not_matter(spark):
    d = spark.createDataFrame([(i, f"We leverage it {i}. Again! Again! # no") for i in range(20)], "doc_id long, text string")
    key = ("doc_id", "detector", "at")
    assert rows(L.lint(d.repartition(1)), *key) == rows(L.lint(d.repartition(7)), *key)


def test_python_cfg(spark):
    text = "def f(x):\n    if x > 0:\n        return 1\n    while x:\n        x += 1\n        if x == 3:\n            break\n    try:\n        g()\n    except E:\n        raise\n    exit()\n    dead()\n"
    n, e = K.python_cfg(spark.createDataFrame([("a.py", text), ("b.py", "(")], "path string, text string"))
    by = ["path", "function"]
    start = n.filter("kind = 'entry'").select(*by, "node")
    assert {r["kind"] for r in n.collect()} >= {"entry", "branch", "loop", "try", "return", "panic", "exit"}
    assert {r["line"] for r in G.dead_branches(n, e, start, by).collect()} == {13}
    found = G.exit_path_findings(G.simple_paths(e, start, G.exit_nodes(n), by), by).collect()
    assert any(r["conditions"] == "x > 0" for r in found) and not any(r["contradiction"] for r in found)


def test_config_and_manifest(spark):
    cfg = files_source.configured("buzzwords: {throttle: [zap]}\nlimits: {em_dashes_per_paragraph: 5}\nprofile_defaults: {max_sentence_length: 9}\nprofiles:\n- {name: a, globs: ['x/**'], rules: {broad_terms: [Thing]}}\nunknown: 1\n")
    assert cfg.buzzwords == ("zap",) and cfg.em_dashes == 5 and cfg.rules.max_sentence_length == 9 and cfg.rules.broad_terms == () and cfg.resolved("a").broad_terms == ("thing",)
    m = files_source.cargo_manifests(spark.createDataFrame([("Cargo.toml", '[workspace]\nmembers = ["core", "cli"]\n'), ("core/Cargo.toml", '[package]\nname = "demo-core"\n\n[lib]\npath = "src/l.rs"\n')], "path string, text string"))
    assert {r["path"]: (r["name"], r["members"], r["lib_path"]) for r in m.collect()} == {"Cargo.toml": ("", ["core", "cli"], ""), "core/Cargo.toml": ("demo_core", [], "src/l.rs")}


def test_more_sinks(spark):
    d = spark.createDataFrame([(1, "We delve into it."), (2, "We utilize it.")], "doc_id long, text string")
    found = L.findings(d, detectors=["D3"])
    from prosemill.operators.prose import with_suggestions

    assert rows(with_suggestions(found), "suggestion") == ["look at", "use"]
    assert sinks.human_report(found).first()["text"].startswith("1:1:4 hint [buzzword]") and sinks.fix_prompt(found).count() == 2
    assert {r["part"] for r in sinks.review_bundle(a=found.select("doc_id"), b=d).collect()} == {"a", "b"}
    assert "unmapped" in sinks.yaml_text(G.mapping_template(d.select(F.lit("p").alias("path")), spark.createDataFrame([], "old string, new string, score double")), "mapping")
    heads = spark.createDataFrame([(1, 0, "A b"), (1, 9, "a B!"), (2, 0, "A b")], "doc_id long, at long, title string")
    assert rows(X.heading_slugs(heads), "doc_id", "slug") == [(1, "a-b"), (1, "a-b-1"), (2, "a-b")]
    assert X.contains_text(d, "DELVE", "text").count() == 1
    r = d.filter("doc_id = 1").select(X.first_bounded(F.col("text"), "delve").alias("a"), X.snippet(F.col("text"), F.lit(3), F.lit(8)).alias("b"), X.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9)).alias("c"), X.capitalized(F.lit("éa")).alias("d"), X.yaml_quoted(F.lit('a"b')).alias("e"), G.edge_kind(F.lit("Imports ")).alias("f")).first()
    assert tuple(r) == (4, "delve", "b\nc", "Éa", '"a\\"b"', "import")
    v = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "path string, language string")
    e = spark.createDataFrame([("a", "b", "use", True), ("a", "zz", "use", False)], "from string, to string, kind string, resolved boolean")
    assert G.shown_edges(e, v).count() == 1
    sizes = {r["component"]: (r["n_nodes"], r["n_edges"]) for r in G.component_sizes(G.components(v, e.filter("resolved")), e.filter("resolved"), v).collect()}
    assert sizes == {"a": (2, 1), "c": (1, 0)}
    assert rows(G.guard(v, v.filter("path <> 'c'"), spark.createDataFrame([], "old string, action string, targets array<string>")), "old", "issue") == [("c", "unmapped")]
    calls = spark.createDataFrame([("a", "b", "f", "F"), ("a", "c", None, "x"), ("a", "f", "g", "G")], "file string, caller string, callee string, raw string")
    assert rows(G.call_lists(calls, "f"), "role", "other") == [("callee", "g"), ("caller", "b")]
