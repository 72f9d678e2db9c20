"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A window is 10 words (an item of fewer words is one window). With 5-word grams
and the least of each 6 neighbouring gram hashes kept as a fingerprint, two
texts that share any 10 words share a fingerprint (10 = 5 + 6 - 1). For a
shorter item of n words the gram is min(5, n) words and n - gram + 1 neighbours
are compared, so the guarantee holds for it too. Documents' fingerprints are
joined with the benchmark's, and hits are extended: each window whose
fingerprint was hit is compared as text.

Hashes are taken in place in an exploded index, so positions never leave the
generated code of one stage; only hits are shuffled, by document. The benchmark's
windows and the item ids that they name are counted: up to ``SENT`` together are
broadcast, more are joined by shuffles.

Null, empty and blank texts have no words. A very long text is one row, its hits
rows of their own. Windows may overlap: each occurrence counts, so there are no
ties. Extra columns are carried or left out, whatever their names. An empty
benchmark marks nothing; an empty table gives an empty result. A repeated row gives its result again; rows that share a
``doc_id`` but not a text stay apart. Items without words occur nowhere; repeated
items count once; a window of an item without an id marks words and names no item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.shared import ascii_lower, cut

WINDOW, GRAM = 10, 5
#: Distinct benchmark windows and item ids in them that are broadcast at most.
SENT = 200_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts whose A-Z are not lower-cased.
RAW_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SPLIT), lambda w: w != "")


def _with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``g1`` to ``g5``, as far as windows of these lengths need them: gram hashes of ``words`` by gram size."""
    sizes = sorted({min(GRAM, n) for n in lengths})
    df = df.filter(F.size("words") >= min(lengths)).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    gram = lambda k: lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)])
    every = lambda k: F.when(F.size("h") >= k, F.transform(F.sequence(F.lit(0), F.size("h") - k), gram(k)))
    return df.withColumns({f"g{k}": every(k) for k in sizes}).drop("h")


def _near(length: int) -> int:
    """Neighbouring grams of a window."""
    return length - min(GRAM, length) + 1


def _least(at: Column, length: int) -> Column:
    """The fingerprint of the window that starts at ``at``: the least of its gram hashes."""
    near = [F.get(f"g{min(GRAM, length)}", at + j) for j in range(_near(length))]
    return F.least(*near) if len(near) > 1 else near[0]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(length, window, mark, items): the distinct windows of all items with their fingerprints and ids."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words")).filter(F.size("words") > 0)
    out = []
    for length in range(1, WINDOW + 1):
        own = words if length == WINDOW else words.filter(F.size("words") == length)
        at = _with_grams(own, [length]).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - length)))
        out.append(at.select("item", F.lit(length).alias("length"), F.array_join(F.slice("words", F.col("i") + 1, length), " ").alias("window"), _least(F.col("i"), length).alias("mark")))
    return reduce(DataFrame.unionByName, out).groupBy("length", "window", "mark").agg(F.collect_set("item").alias("items"))


def _kept(n: int) -> Column:
    """The fingerprint of the window of n words at ``i`` where it is kept, else null: where it changes, and at least once in as many windows as it can stand for."""
    i = F.col("i")
    return F.when((i <= F.size("words") - n) & ((i % _near(n) == 0) | (_least(i, n) != _least(i - 1, n))), _least(i, n))


def _looked_up(placed: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, words, i, length) of hits: the marks are broadcast and looked up in place, so nothing is shuffled."""
    for n in lengths:
        marks = windows.filter(F.col("length") == n).select(F.col("mark").alias(f"m{n}"), F.lit(n).alias(f"n{n}")).distinct()
        placed = placed.join(F.broadcast(marks), _kept(n) == F.col(f"m{n}"), "left")
    which = F.filter(F.array(*[F.col(f"n{n}") for n in lengths]), lambda n: n.isNotNull())
    any_ = reduce(Column.__or__, [F.col(f"n{n}").isNotNull() for n in lengths])
    return placed.filter(any_).select("doc_id", "text_hash", "words", "i", F.explode(which).alias("length"))


def _joined(placed: DataFrame, base: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for marks beyond the bound: kept fingerprints are shuffled without their texts, hits meet the texts again."""
    kept = F.filter(F.array(*[F.struct(F.lit(n).alias("length"), _kept(n).alias("mark")) for n in lengths]), lambda x: x["mark"].isNotNull())
    prints = placed.select("doc_id", "text_hash", "i", F.explode(kept).alias("x")).select("doc_id", "text_hash", "i", "x.*")
    found = prints.join(windows.select("length", "mark").distinct(), ["length", "mark"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("i", "length")).alias("xs"))
    other = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "xs")
    met = base.dropDuplicates(["doc_id", "text_hash"]).join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    return met.select("doc_id", "text_hash", "words", F.explode("xs").alias("x")).select("doc_id", "text_hash", "words", "x.*")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, items): where windows of items occur, of the documents that have any.

    One pass splits and hashes a document for all window lengths; at each word, the fingerprints of all
    lengths are looked up, each in the marks of its length.
    """
    windows = cut(item_windows(benchmark))
    counts = {r["length"]: r["n"] for r in windows.groupBy("length").agg((F.count("*") + F.sum(F.size("items"))).alias("n")).collect()}  # 10 rows at most
    small, lengths = sum(counts.values()) <= SENT, sorted(counts) or [WINDOW]
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))
    placed = _with_grams(base, lengths).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - min(lengths))))
    hit = _looked_up(placed, windows, lengths) if small else _joined(placed, base, windows, lengths)
    i = F.col("i")
    last = F.least(i + F.col("length") - F.least(F.col("length"), F.lit(GRAM)), F.size("words") - F.col("length"))
    run = hit.withColumn("at", F.explode(F.sequence(i, last)))
    text = run.select("doc_id", "text_hash", "at", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"))
    named = windows.select("length", "window", "items")
    every = text.join(F.broadcast(named) if small else named, ["length", "window"]).select("doc_id", "text_hash", F.struct("at", (F.col("at") + F.col("length")).alias("end")).alias("span"), "items")
    return every.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and the hit ``spans`` of words."""
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = hits(own, benchmark.select("item_id", F.col("text").cast("string").alias("text"))).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans", "items")
    every = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], F.col("doc_id").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"), F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), RAW_SPLIT), lambda w: w != "")).cast("long").alias("n_words"))
    joined = every.join(found, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("hit_hash")), "left")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    # spans are in order of their starts: what each adds is what lies beyond the furthest end so far
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["at"]))).alias("n")), lambda a: a["n"])
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = joined.withColumn("n_hit", F.coalesce(covered, F.lit(0)).cast("long")).withColumn("n_items", F.size(items).cast("long")).withColumn("items_sha256", F.sha2(F.array_join(items, ","), 256))
    return out.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")
