"""Suppression: which bytes of a document detectors must not look at, and which lines they must not report.

Markers are HTML comments of the form ``<!-- name:off -->``; any lower-case name is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill import config as C
from prosemill.functions.text import add_hops, add_parts, add_running, add_spans, last_before, pin

OFF = r"(?s)<!-- [a-z]+:off -->.*?(?:<!-- [a-z]+:on -->|\z)"
IGNORE = r"(?s)<!--\s*[a-z]+:ignore\s+[^>]*?-->.*?(?:<!--\s*[a-z]+:end-ignore\s*-->|\z)"
IGNORE_LINE = r"<!--\s*[a-z]+:ignore-line\s*-->"
ALONE = r"(?U)^\s*<!-- [a-z]+:ignore-line -->\s*$"
INLINE = r"(?<!`)`(?!``)[^`\n]*`"
_NONE = "array<struct<category:string,at:bigint,to:bigint>>"


def _mask(x: Column, category: Column | None = None) -> Column:
    return F.struct((F.lit(None).cast("string") if category is None else category).alias("category"), x["at"].alias("at"), x["to"].alias("to"))


def add_masks(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``masks`` (category or null for all, at, to) and ``ignored``, the suppressed line numbers; for ``visible``
    also ``hops``, the masks for all as ``mask_at`` and ``mask_to`` (the furthest end so far), and ``named_masks``."""
    c = F.coalesce(F.col(text), F.lit(""))
    df = add_spans(add_hops(df, text), {"_off": OFF, "_ign": IGNORE, "_code": INLINE, "_url": C.URL}, text)
    df = add_parts(df, "_lines", F.split(c, r"(?<=\n)"))
    named = F.create_map(*[F.lit(x) for k in [*C.CATEGORIES, *C.CATEGORY_ALIASES] for x in (k, C.category(k))])
    listed = lambda x: F.filter(F.transform(F.split(F.regexp_extract(x["m"], r"<!--\s*[a-z]+:ignore\s+([^>]*?)-->", 1), ","), lambda n: F.try_element_at(named, F.lower(F.trim(n)))), lambda n: n.isNotNull())
    by_category = F.flatten(F.transform("_ign", lambda x: F.when(F.size(listed(x)) > 0, F.transform(listed(x), lambda n: _mask(x, n))).otherwise(F.array(_mask(x)))))
    fence = F.filter("_lines", lambda x: x["s"].rlike(r"(?U)^\s*(?:```|~~~)"))
    df = df.withColumn("_fence", fence)
    # fence lines pair up in turn; a last one without a partner reaches the end
    blocks = F.filter(F.transform("_fence", lambda x, i: F.when(i % 2 == 0, F.struct(x["at"].alias("at"), F.coalesce(F.get("_fence", i + 1)["at"] + F.octet_length(F.get("_fence", i + 1)["s"]), F.octet_length(c).cast("bigint")).alias("to")))), lambda x: x.isNotNull())
    front = F.when(F.trim(F.regexp_extract(c, r"^([^\n]*)", 1)) == "---", F.array(F.struct(F.lit(None).cast("string").alias("category"), F.lit(0).cast("bigint").alias("at"), F.octet_length(F.regexp_extract(c, r"^([^\n]*\n?)", 1)).cast("bigint").alias("to")))).otherwise(F.array().cast(_NONE))
    df = df.withColumn("masks", F.concat(F.transform("_off", lambda x: _mask(x)), by_category.cast(_NONE), front, F.transform(blocks, lambda x: _mask(x))))
    df = _ordered(df, "_base", F.filter("masks", lambda m: m["category"].isNull()))
    df = pin(df.withColumn("_code", F.filter("_code", lambda x: ~_covered("_base", x["at"]))), "masks", "_code", "_base_at", "_base_to")
    df = _ordered(df, "_own", F.col("_code"))
    df = df.withColumn("_url", F.filter("_url", lambda x: ~_covered("_base", x["at"]) & ~_covered("_own", x["at"])))
    df = df.withColumn("masks", F.concat("masks", F.transform("_code", lambda x: _mask(x)), F.transform("_url", lambda x: _mask(x))))
    df = _ordered(pin(df, "masks"), "mask", F.filter("masks", lambda m: m["category"].isNull()))
    df = df.withColumn("named_masks", F.filter("masks", lambda m: m["category"].isNotNull()))
    marks = F.flatten(F.transform("_lines", lambda x, i: F.when(x["s"].rlike(ALONE), F.array(i + 1, i + 2)).when(x["s"].rlike(IGNORE_LINE), F.array(i + 1)).otherwise(F.array().cast("array<int>"))))
    return df.withColumn("ignored", marks).drop("_off", "_ign", "_code", "_url", "_lines", "_fence", "_base_at", "_base_to", "_own_at", "_own_to")


def _ordered(df: DataFrame, name: str, spans: Column) -> DataFrame:
    """Adds starts (ascending) and the furthest end up to each, so that the last span that begins before a byte tells whether any covers it."""
    df = df.withColumn("_spans", F.sort_array(F.transform(spans, lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to")))))
    df = add_running(df, {f"{name}_to": "transform(_spans, x -> x.to)"}, most=True)
    return df.withColumn(f"{name}_at", F.transform("_spans", lambda x: x["at"])).drop("_spans")


def _covered(name: str, at: Column) -> Column:
    return (F.size(f"{name}_at") > 0) & F.coalesce(F.get(f"{name}_to", last_before(f"{name}_at", at)) > at, F.lit(False))


def visible(at: Column, category: str) -> Column:
    """Whether a detector of a category may look at a byte."""
    named = F.exists("named_masks", lambda m: (m["category"] == category) & (at >= m["at"]) & (at < m["to"]))
    return ~_covered("mask", at) & ~((F.size("named_masks") > 0) & named)


def anchor(text: Column) -> Column:
    """The first byte that no global mask covers; 0 for an empty text, null if all is covered."""
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.col("mask_to"))
    free = F.filter(ends, lambda e: (e < F.octet_length(text)) & ~_covered("mask", e))
    return F.when(F.octet_length(text) == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(free))
