"""Flow specifications: parsing front matter and checking what a specification must hold."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.session import ship

LISTS = ("inputs", "outputs", "side_effects", "failure_modes", "observability", "steps", "invariants", "tags", "owners")
SPEC = "path string, name string, entrypoint string, language string, " + ", ".join(f"{x} array<string>" for x in LISTS) + ", justifications array<struct<item:string,reason:string,evidence:string,tradeoff:string>>, error string"


@dataclass(frozen=True)
class FlowRules:
    min_steps: int = 3
    max_steps: int = 12
    min_invariants: int = 3
    reasons: tuple[str, ...] = ("variation", "isolation", "reuse", "policy", "volatility")


def _parse(batches):
    import yaml

    text = pa.string()
    just = pa.list_(pa.struct([(k, text) for k in ("item", "reason", "evidence", "tradeoff")]))
    schema = pa.schema([("path", text), ("name", text), ("entrypoint", text), ("language", text), *((x, pa.list_(text)) for x in LISTS), ("justifications", just), ("error", text)])
    listed = lambda x: [str(v) for v in x] if isinstance(x, list) else []
    for batch in batches:
        out = []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            body = raw or ""
            if body.lstrip().startswith("---"):
                body = body.lstrip()[3:].split("\n---", 1)[0]
            try:
                d = yaml.safe_load(body)
                if not isinstance(d, dict):
                    raise ValueError("no mapping")
                row = {"path": path, "name": str(d.get("name") or ""), "entrypoint": str(d.get("entrypoint") or ""), "language": d.get("language") and str(d["language"]), "error": None}
                row |= {x: listed(d.get(x)) for x in LISTS}
                row["justifications"] = [{k: str(j.get(k) or "") for k in ("item", "reason", "evidence", "tradeoff")} for j in d.get("justifications") or [] if isinstance(j, dict)]
            except (yaml.YAMLError, ValueError) as e:
                row = {"path": path, "name": "", "entrypoint": "", "language": None, "error": str(e).split("\n")[0], "justifications": [], **{x: [] for x in LISTS}}
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema)


def parsed(files: DataFrame) -> DataFrame:
    """Specifications from YAML texts, or the front matter of Markdown: one Arrow pass. What fails to parse has ``error``."""
    ship(files.sparkSession)
    return files.select("path", "text").mapInArrow(_parse, SPEC)


def issues(specs: DataFrame, rules: FlowRules | None = None) -> DataFrame:
    """(path, severity, field): all checks inside the row, then one generator."""
    rules = rules or FlowRules()
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    n = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    issue = lambda severity, field: F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"))
    when = lambda c, severity, field: F.when(c, issue(severity, field))
    one: list[Column] = [
        when(blank(F.col("name")), "error", "name"),
        when(blank(F.col("entrypoint")), "error", "entrypoint"),
        when(n("steps") == 0, "error", "steps"),
        when((n("steps") > 0) & (n("steps") < rules.min_steps), "warning", "steps"),
        when(n("steps") > rules.max_steps, "warning", "steps"),
        when(n("invariants") < rules.min_invariants, "warning", "invariants"),
        *[when(n(x) == 0, "warning", x) for x in ("inputs", "outputs", "side_effects", "failure_modes")],
        when(F.size("justifications") <= 0, "warning", "justifications"),
    ]
    each = F.flatten(F.transform("justifications", lambda j: F.array(F.when(blank(j["item"]), issue("warning", "justifications.item")), F.when(~F.lower(j["reason"]).isin(*rules.reasons), issue("warning", "justifications.reason")))))
    found = F.filter(F.concat(F.array(*one), F.coalesce(each, F.array().cast("array<struct<severity:string,field:string>>"))), lambda x: x.isNotNull())
    return specs.select("path", F.explode(found).alias("x")).select("path", "x.severity", "x.field")


def directory_issues(specs: DataFrame, rules: FlowRules | None = None) -> DataFrame:
    """Issues of specifications that parse, an error for each that does not, a warning where there is none."""
    good = issues(specs.filter("error IS NULL"), rules)
    bad = specs.filter("error IS NOT NULL").select("path", F.lit("error").alias("severity"), F.lit("parse").alias("field"))
    none = specs.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("path"), F.lit("warning").alias("severity"), F.lit("specs").alias("field"))
    return good.unionByName(bad).unionByName(none)


def template(name: str, entrypoint: str) -> str:
    """A specification to fill in."""
    lists = "".join(f"{x}:\n  - TODO\n" for x in LISTS[:7])
    return f"---\nname: {name}\nentrypoint: {entrypoint}\n{lists}justifications:\n  - item: TODO\n    reason: reuse\n    evidence: TODO\n    tradeoff: TODO\n---\n\n# {name}\n"
