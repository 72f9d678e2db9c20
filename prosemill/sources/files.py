"""Readers: file trees, snapshots and configuration as DataFrames."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators.repo import matches

EDGES = "struct<`from`:string,`to`:string,to_raw:string,kind:string,line:int,resolved:boolean>"


def tree(spark: SparkSession, root: str, glob: str = "*", ignore=(), max_kb: int | None = None, content: bool = True) -> DataFrame:
    """(path, size_bytes[, text]) of files below ``root``, paths relative to it.

    Sizes filter the listing; without ``content`` no file is opened. Invalid UTF-8 decodes lossily.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    if max_kb is not None:
        raw = raw.filter(F.col("length") <= max_kb * 1024)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    path = F.regexp_replace(F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base + "/", -1), r"^\./", "")
    out = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), *([F.make_valid_utf8(F.col("content").cast("string")).alias("text")] if content else []))
    return out.filter(~matches(F.col("path"), ignore)) if ignore else out


def walk_issues(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(category, path, message) of folders that cannot be listed; what can be listed gives nothing.

    One listing for each folder, on the driver, as Spark's own file index does before a scan.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left, out = [jvm.org.apache.hadoop.fs.Path(r) for r in roots], []
    while left:
        folder = left.pop()
        try:
            left += [x.getPath() for x in folder.getFileSystem(conf).listStatus(folder) if x.isDirectory()]
        except Py4JJavaError as error:
            out.append(("walk", folder.toString(), str(error.java_exception.getMessage()).split("\n")[0]))
    return spark.createDataFrame(out, "category string, path string, message string")


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph snapshot in JSON."""
    whole = spark.read.schema(f"nodes array<struct<path:string,language:string,size_bytes:bigint,lines:int>>, edges array<{EDGES}>").json(path, multiLine=True)
    return whole.select(F.explode("nodes").alias("x")).select("x.*"), whole.select(F.explode("edges").alias("x")).select("x.*")


def mapping(entries: DataFrame) -> DataFrame:
    """Mapping entries (old, action, targets, ord): of several for one path the last stays."""
    return entries.groupBy("old").agg(F.max_by(F.struct("action", "targets"), "ord").alias("x")).select("old", "x.*")


def yaml_config(text: str) -> dict:
    """A configuration file; unknown keys are left to the caller."""
    import yaml

    return yaml.safe_load(text) or {}


def tracked(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files with ``git_tracked``: whether a listing of tracked paths has them."""
    known = listed.select("path").distinct().withColumn("git_tracked", F.lit(True))
    return files.join(known, "path", "left").withColumn("git_tracked", F.coalesce("git_tracked", F.lit(False)))


def cargo_manifests(files: DataFrame) -> DataFrame:
    """(path, name, members, lib_path): package names (hyphens as underscores), members and library paths of Cargo manifests."""
    own = files.filter(F.col("path").rlike(r"(?:^|/)Cargo\.toml$"))
    section = lambda name: F.regexp_extract("text", rf"(?s)(?:^|\n)\[{name}\]\s*\n(.*?)(?:\n\[|\z)", 1)
    value = lambda body, key: F.regexp_extract(body, rf'(?m)^\s*{key}\s*=\s*"([^"]*)"', 1)
    lib = value(section("lib"), "name")
    members = F.regexp_extract_all(F.regexp_extract(section("workspace"), r"(?s)members\s*=\s*\[(.*?)\]", 1), F.lit('"([^"]*)"'), 1)
    return own.select("path", F.translate(F.when(lib != "", lib).otherwise(value(section("package"), "name")), "-", "_").alias("name"), members.alias("members"), value(section("lib"), "path").alias("lib_path"))


def configured(text: str):
    """A ``Config`` from YAML. Keys that are not known are ignored; a profile or ``profile_defaults`` that sets some rules has the plain defaults for the others."""
    from dataclasses import replace

    from prosemill.config import Config, Profile, Rules

    d = yaml_config(text)
    names = {"call_to_action_phrases": "calls_to_action", "template_phrases": "templates", "confidence_phrases": "confidence", "max_bullet_items": "max_bullets", "max_exclamations_per_paragraph": "max_exclamations", "min_sentences_per_section": "min_section_sentences", "enable_triad_slop": "triad"}

    def rules(x: dict | None) -> Rules:
        known = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in (x or {}).items()}
        return Rules(**{k: v for k, v in known.items() if k in Rules.__dataclass_fields__})

    out = Config()
    for key, name, inner in (("buzzwords", "buzzwords", "throttle"), ("transitions", "transitions", "throttle"), ("puffery", "puffery", "ban"), ("weasel", "weasel", "ban"), ("marketing_cliches", "marketing", "ban"), ("templates", "templates", "ban"), ("whitelist", "allowed_phrases", "allowed_phrases")):
        if isinstance(d.get(key), dict) and inner in d[key]:
            out = replace(out, **{name: tuple(d[key][inner] or ())})
    limits = {"em_dashes_per_paragraph": "em_dashes", "connectors_per_sentence": "connectors", "rule_of_three_per_paragraph": "rule_of_three", "bold_spans_per_paragraph": "bold_spans", "bold_lead_bullets_per_list": "bold_lead_bullets", "warn_threshold_per_100w": "warn_per_100", "fail_threshold_per_100w": "fail_per_100"}
    found = {**(d.get("limits") or {}), **(d.get("scores") or {})}
    out = replace(out, **{limits[k]: int(v) for k, v in found.items() if k in limits})
    if "profile_defaults" in d:
        out = replace(out, rules=rules(d["profile_defaults"]))
    profiles = tuple(Profile(p["name"], tuple(p.get("globs") or ()), p.get("extends"), rules(p.get("rules"))) for p in d.get("profiles") or [] if str(p.get("name") or "").strip())
    return replace(out, profiles=profiles)
