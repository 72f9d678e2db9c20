"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame operations alone.

Words, word pairs and pairs of word endings are hashed into ``BUCKETS`` buckets.
Two multinomials are fitted: the raw corpus, over all documents, and the trusted
target, over up to ``TRUSTED`` rows labelled good (those of the least id hashes).
A document's score is the mean of log(target / raw) over its grams; every
document from ``THRESHOLD`` up that passes the base rules is kept.

Base counts are taken inside the row. Grams are taken at each place of an exploded
index, so they never leave the generated code of one stage: counting the corpus is
an aggregate over bucket numbers, judging it one over documents, both with partial
sums, so that one row of numbers is shuffled for each document and no text.
Weights are whole numbers of 1e-9, so sums don't depend on their order.

Null, empty and blank texts have no words and fail the base rules; their ratio is
0. Without a trusted row every ratio is 0 and the base rules decide alone. Rows
that are equal in all carried columns and the text are judged together, and each
gets the result. A repeated label counts once, as good if any of its rows is; ties
of id hashes go by id. A text of any length is one row: positions are kept as
numbers of their own. Extra columns are carried or left out, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.shared import SPACES

BUCKETS = 1 << 14
TRUSTED = 20_000
#: Pseudo-counts with which the target leans on the raw corpus.
LEAN = float(BUCKETS)
THRESHOLD = -0.4
#: Weights are kept in whole numbers of this.
UNIT = 1e-9


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")


def _places(words: str) -> Column:
    """The index of each word."""
    return F.sequence(F.lit(0), F.greatest(F.size(words), F.lit(1)) - 1)


def grams() -> Column:
    """Bucket numbers of the grams that begin at word ``i`` of ``words``; null beyond the last word."""
    bucket = lambda tag, *c: F.pmod(F.xxhash64(F.lit(tag), *c), F.lit(BUCKETS)).cast("int")
    one, two = F.get("words", F.col("i")), F.get("words", F.col("i") + 1)
    end = lambda w: F.substring(w, -2, 2)
    return F.array(F.when(one.isNotNull(), bucket(1, one)), F.when(two.isNotNull(), bucket(2, one, two)), F.when(two.isNotNull(), bucket(3, end(one), end(two))))


def fit(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> list[int]:
    """log(target / raw) of each bucket, in units. One aggregate of ``BUCKETS`` rows reaches the driver."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1").select(F.col("doc_id").alias("good_id"))
    # bounded by the limit, so it can be sent
    good = F.broadcast(good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted).withColumn("good", F.lit(1)))
    own = docs.join(good, F.col("doc_id") == F.col("good_id"), "left").select("good", words_of("text").alias("words"))
    each = own.withColumn("i", F.explode(_places("words"))).select("good", F.explode(grams()).alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counted.filter("bucket IS NOT NULL").collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n, t = sum(raw), sum(target)
    p = [(x + 1) / (n + BUCKETS) for x in raw]
    return [round(math.log((x + LEAN * q) / (t + LEAN) / q) / UNIT) for x, q in zip(target, p)]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``words``, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``.

    A text none of whose 3-word windows is met twice is known by the number of distinct window hashes. Those of the
    others are sorted with their places: equal ones stand side by side.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, text.alias("text"), words_of("text").alias("words"), lines.alias("lines"))
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    df = df.withColumn("windows", F.when(F.size("h") >= 4, F.transform(F.sequence(F.lit(0), F.size("h") - 3), window)))
    df = df.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("sorted", lambda x, j: _same(x["h"], F.get("sorted", j - 1)["h"]) | _same(x["h"], F.get("sorted", j + 1)["h"]))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns (``doc_id`` if None), the base counts, ``base_failed``, ``kept`` and the ratio ``llr``.

    Carried columns are what documents are grouped by: name an id, not the text (``keep`` gives whole documents).
    """
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    text = F.col("text").cast("string")
    weights = fit(docs.select("doc_id", text.alias("text")), labels.select("doc_id", "quality"))
    # a constant, folded once: the weights travel with the plan, their number is fixed
    weight = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], F.xxhash64(text).alias("t"), text.alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = [*inner, "t", *counts]
    each = base_counts(own, [*inner, "t"]).withColumn("i", F.explode(_places("words"))).select(*key, "i", grams().alias("g"))
    of = lambda k: F.coalesce(F.get(weight, F.get("g", F.lit(k))), F.lit(0).cast("bigint"))
    summed = each.groupBy(*key).agg(F.sum(of(0) + of(1) + of(2)).alias("w"), F.count(F.when(F.col("i") == 0, 1)).alias("copies"))
    n = F.greatest(3 * F.col("n_words") - 2, F.lit(1)) * F.col("copies")
    out = summed.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("llr", F.round(F.col("w") / n * UNIT, 9))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    # a generator of one row: without it the optimizer would copy all base counts into a caller's filter on ``kept``
    names = [*counts, "base_failed", "kept", "llr"]
    verdict = out.select(*inner, F.explode(F.array(F.struct(*names))).alias("verdict"))
    return verdict.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], *[F.col(f"verdict.{n}").alias(n) for n in names])


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, all their columns as they were. Verdicts meet the documents by id and text hashes."""
    names = [f"key{i}" for i in range(len(docs.columns) + 2) if f"key{i}" not in docs.columns][:2]
    text = F.col("text").cast("string")
    keyed = docs.withColumns({names[0]: F.xxhash64("doc_id", text), names[1]: F.xxhash64(text, F.lit("|"), "doc_id")})
    kept = judge(keyed, labels, carry=names, threshold=threshold).filter("kept").select(*names).distinct()
    return keyed.join(kept, names, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
