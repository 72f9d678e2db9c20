"""Rust, TypeScript and JavaScript sources, and audits of them."""

from prosemill.operators import braces as B
from prosemill.operators import graph as G
from prosemill.plans import audit as A
from prosemill.sources import files as files_source

RUST = r'''
// fn not_me() { if { }
pub trait Go<T> { fn go(&self, a: i32) -> i32; fn also(&self, a: i32) -> i32 { self.go(a) } }
impl<'a> Go<u8> for S<'a> { fn go(&self, a: i32) -> i32 { Self::inner(&a) } }
async fn forward(a: String, b: &str) -> Result<(), E> { target(a.clone(), b).await? }
fn not_forward(a: i32, b: i32) -> i32 { target(b, a) }
fn work(x: Option<i32>, v: Vec<i32>) -> i32 {
    let y = x.unwrap(); /* { */
    if y > 3 { return 1; } else if y == 2 { panic!("no {") }
    let mut n = '{' as i32;
    for i in 0..y { if i == 2 { continue; } n += v[i]; }
    let z = match n { 0 => return 0, 1 | 2 => 5, _ => { step(); 7 } };
    loop { n -= 1; if n < 0 { break; } }
    assert!(z > n);
    std::process::exit(2);
    z
}
'''
SCRIPT = r'''
import React, { x } from 'react';
export class Sq extends Base implements Shape, Other {
  constructor(private readonly a: Dim, b?: string) { super(a); }
  async run(q: Query): Promise<void> { return await this.go(q); }
  static of = (n: Num) => make(n);
}
const arrow = async (p: Props): Promise<{x: number}> => {
  if (p.ok) return 1
  switch (p.k) { case 'a': go(); break; default: stop() }
  try { risky(/a\/b{/g, `${'{'}`) } catch (e) { throw new Error('not implemented') } finally { done() }
  do { n++ } while (n < 3)
  for (const z of p.items) { if (!z) continue; process.exit(1) }
  return { a: b ? c : d }
}
const one = x => twice(x);
function braces(t: {a: number}): { b: number } { return h(t) }
'''


def _files(spark):
    return spark.createDataFrame([("src/a.rs", RUST), ("src/b.ts", SCRIPT), ("src/broken.ts", "function f( {"), ("src/none.js", None), ("src/c.py", "def f(a):\n    pass\n")], "path string, text string")


def test_functions_and_types(spark):
    got = {(r["target"], r["kind"]): r for r in B.source_index(_files(spark)).collect()}
    assert {k: r["forwards"] for k, r in got.items() if r["forwards"]} == {("Go::also", "method"): "Go::go", ("S::go", "method"): "S::inner", ("forward", "function"): "target", ("Sq::run", "method"): "Sq::go", ("Sq::of", "method"): "make", ("one", "function"): "twice", ("braces", "function"): "h"}
    assert {("Go", "trait"), ("Sq", "class"), ("Sq::constructor", "method"), ("arrow", "function"), ("work", "function"), ("not_forward", "function")} <= got.keys()
    assert got["arrow", "function"]["placeholder"] and not got["work", "function"]["placeholder"]
    assert got["work", "function"]["start_line"] == 7 and got["work", "function"]["end_line"] == 17
    assert [c["raw"] for c in got["work", "function"]["calls"]] == ["x::unwrap", "step", "std::process::exit"] and not any("not_me" in k[0] for k in got)


def test_control_flow(spark):
    nodes, edges = B.source_cfg(_files(spark))
    kinds = {}
    for r in nodes.filter("function IN ('work', 'arrow')").collect():
        kinds.setdefault(r["function"], []).append(r["kind"])
    count = lambda f, k: kinds[f].count(k)
    assert [count("work", k) for k in ("entry", "branch", "loop", "match", "return", "panic", "exit")] == [1, 4, 2, 1, 3, 1, 1]
    assert [count("arrow", k) for k in ("branch", "loop", "match", "try", "panic", "exit", "return")] == [2, 2, 1, 1, 1, 1, 2]
    by = ["path", "function"]
    entries = nodes.filter("kind = 'entry'").select(*by, "node")
    dead = G.dead_branches(nodes, edges, entries, by).filter("function = 'work'").collect()
    assert sorted((r["kind"], r["line"]) for r in dead) == [("block", 16), ("return", 17)]
    conditions = {r["condition"] for r in edges.filter("function = 'work' AND condition IS NOT NULL").collect()}
    assert {"y > 3", "i == 2", "0", "1 | 2", "_", "n < 0"} <= conditions


def test_data_flow(spark):
    flow = B.rust_flow(_files(spark)).filter("function = 'work'")
    got = {(r["variable"], r["kind"], r["line"]) for r in flow.collect()}
    assert {("x", "param", 7), ("x", "unwrap", 8), ("y", "let", 8), ("y", "condition", 9), ("i", "loop", 11), ("y", "read", 11), ("i", "index", 11), ("n", "assign", 11), ("z", "let", 12), ("z", "assertion", 14)} <= got
    params, uses, changes = A.parts(flow)
    found = G.unchecked_unwraps(flow.filter("kind IN ('param', 'let', 'assign', 'loop')"), changes, ["path", "function"])
    assert [(r["parameter"], r["unwrap_line"], r["param_line"]) for r in found.collect()] == [("x", 8, 7)]
    assert {r["name"] for r in G.unvalidated(params.select("path", "function", "variable", "line").withColumnRenamed("variable", "name"), uses, ["path", "function"]).collect()} == {"x", "v"}


def test_symbols(spark):
    got = {(r["usage_kind"], r["symbol"], r["detail"], r["arg_count"]) for r in B.ts_symbols(_files(spark)).collect()}
    assert {("import", "React", "react", None), ("export", "Sq", "class", None), ("implements", "Shape", "Sq", None), ("implements", "Other", "Sq", None), ("type-annotation", "Dim", None, None), ("type-annotation", "Query", None, None), ("type-annotation", "Props", None, None), ("call", "risky", None, 1), ("call", "process.exit", None, 0)} <= got
    assert not any(s in ("string", "number", "if", "async") for _, s, _, _ in got)


def test_audits(spark):
    files = _files(spark)
    got = {(r["category"], r["symbol"]) for r in A.audit(files).collect()}
    assert {("pass-through", "forward -> target"), ("lonely-abstraction", "Go"), ("placeholder", None)} <= got
    logic = {(r["category"], r["function"], r["detail"]) for r in A.logic_audit(files).collect()}
    assert {("validation-gap", "work", "v"), ("dead-branch", "work", "return"), ("exit-path", "work", "y > 3")} <= logic
    assert not A.audit(files.filter("false")).count() and not A.logic_audit(files.filter("false")).count()


def test_walk_issues(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    got = files_source.walk_issues(spark, [str(tmp_path), str(tmp_path / "gone")]).collect()
    assert [(r["category"], r["path"].rsplit("/", 1)[-1]) for r in got] == [("walk", "gone")] and got[0]["message"]
