"""Writers: records as JSON lines, Markdown and Mermaid texts, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(tag: str, **parts: DataFrame) -> DataFrame:
    """(ord, value): rows of all parts as JSON objects tagged with their kind, in the order given."""
    tagged = [df.select(F.lit(i).alias("ord"), F.to_json(F.struct(F.lit(kind).alias(tag), *[F.col(f"`{c}`") for c in df.columns])).alias("value")) for i, (kind, df) in enumerate(parts.items())]
    return reduce(DataFrame.union, tagged)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Writes ``records``; the kinds keep their order across part files."""
    rows.repartitionByRange("ord").sortWithinPartitions("ord", "value").select("value").write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def mermaid(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, mermaid): a flow chart of each control-flow graph."""
    n = F.concat(F.lit("  n"), "node", F.when(F.col("kind").isin("entry", "return", "exit"), F.concat(F.lit("(["), "kind", F.lit("])"))).when(F.col("kind").isin("branch", "match"), F.concat(F.lit("{"), "kind", F.lit("}"))).otherwise(F.concat(F.lit("["), "kind", F.lit("]"))))
    e = F.concat(F.lit("  n"), "from", F.lit(" --> "), F.when(F.col("condition").isNotNull(), F.concat(F.lit("|"), "condition", F.lit("| "))).otherwise(""), F.lit("n"), "to")
    rows = nodes.select(*by, F.lit(0).alias("o"), F.col("node").alias("k"), n.alias("line")).union(edges.select(*by, F.lit(1), F.col("from"), e))
    return rows.groupBy(*by).agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "k", "line"))), lambda x: x["line"]), "\n")).alias("mermaid"))


def proposal(found: DataFrame) -> DataFrame:
    """(category, markdown): findings of each category as a Markdown list, in order of path."""
    line = F.concat(F.lit("- `"), "path", F.lit("` "), "message")
    return found.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("xs")).select("category", F.concat(F.lit("## "), "category", F.lit("\n\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def diff_markdown(changes: DataFrame) -> DataFrame:
    """(change, markdown) of a snapshot diff."""
    return changes.groupBy("change").agg(F.sort_array(F.collect_list("path")).alias("p")).select("change", F.concat(F.lit("### "), "change", F.lit("\n"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("markdown"))


def exit_status(reports: DataFrame) -> DataFrame:
    """One row: 1 if any document's verdict is ``fail``, else 0."""
    return reports.agg(F.coalesce(F.max((F.col("verdict") == "fail").cast("int")), F.lit(0)).alias("status"))


def yaml_text(rows: DataFrame, key: str) -> str:
    """A YAML list of a bounded report: calibration values, mapping templates."""
    import yaml

    return yaml.safe_dump({key: [r.asDict(recursive=True) for r in rows.collect()]}, sort_keys=False)


def human_report(found: DataFrame, n: int = 20) -> DataFrame:
    """(text): the first n findings in order of document and place, a line each."""
    top = found.orderBy("doc_id", "at", "detector").limit(n)
    return top.select(F.format_string("%s:%s:%s %s [%s] %s", F.col("doc_id").cast("string"), F.col("line").cast("string"), F.col("column").cast("string"), "severity", "category", "snippet").alias("text"))


def fix_prompt(found: DataFrame) -> DataFrame:
    """(doc_id, prompt): what to change in each document, in order of place."""
    line = F.concat(F.lit("- line "), F.col("line").cast("string"), F.lit(": "), "message")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("s")))).alias("x")).select("doc_id", F.concat(F.lit("Fix:\n"), F.array_join(F.transform("x", lambda x: x["s"]), "\n")).alias("prompt"))


def review_bundle(n: int = 8, **parts: DataFrame) -> DataFrame:
    """(part, sample): up to n rows of each report as one JSON text, in the order of all columns."""
    out = []
    for name, df in parts.items():
        top = df.orderBy(*df.columns).limit(n)
        out.append(top.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("sample")).select(F.lit(name).alias("part"), "sample"))
    return reduce(DataFrame.union, out)
