"""Toxicity by a factorization machine over hashed terms.

Terms are words (A-Z lower-cased) and their first four and five bytes, hashed
into 2**18 buckets; a document has each term or not. Besides a weight each term
has a factor vector, and the product of two terms' vectors scores their meeting
in one text: an insult beside the mention of a group weighs more than both alone.

Two steps learn from the labelled sample, up to ``PER_LABEL`` rows of each label
from the learning folds (those of the least id hashes). A scan counts in how many
toxic and other texts each bucket stands. Of m buckets in two texts or more (and
absent from as many), those whose chi-squared passes 2 ln m are kept, about the
largest that m buckets reach by chance, whatever the size of the sample; of more
than ``FEATURES`` the best, ties by number. The machine is fitted on those by
``STEPS`` minibatches of Adagrad with a fixed seed. One more narrow scan scores
every document; nothing of theirs is shuffled.

Null, empty and blank texts have no terms and score the machine's bias. A label
that is repeated counts once, as toxic if any of its rows is; of several texts of
one id the one of the least hash is learned from; labels of absent ids count for
nothing. Without labels of both kinds the score is the share of toxic rows (0.5
without any). Very long texts are read in parts. Repeated rows each get their
score. Ids are of any type; extra columns are carried or left out, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.llm import blocks as B
from prosemill.llm.quality_knn import labelled
from prosemill.llm.shared import crc_mod, cut
from prosemill.session import ship

#: Labelled rows of each label that the machine learns from at most.
PER_LABEL = {0: 12_000, 1: 8_000}
BUCKETS, FEATURES, FACTORS, STEPS = 1 << 18, 1024, 8, 900
FOLDS, THRESHOLD = 5, 0.5
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Separators of texts that are not lower-cased yet.
_RAW_SEPARATOR = _SEPARATOR.copy()
_RAW_SEPARATOR[65:91] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term, with repeats."""
    docs, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi, a, b in B.pieces(data, at, _RAW_SEPARATOR):
        part = _LOWER[data[a:b]]
        begin, end, pointers = B.words(part, np.clip(at[lo : hi + 1] - a, 0, b - a), _SEPARATOR)
        doc = np.repeat(np.arange(lo, hi), np.diff(pointers))
        for tag, size in ((0, None), (1, 4), (2, 5)):
            stop = end if size is None else np.minimum(end, begin + size)
            h = B.mix(B.word_hashes(part, begin, stop) + np.uint64(tag))
            docs.append(doc)
            out.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(out)


def _bucket_counts(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        doc, bucket = terms(*B.column(batch, "text"))
        pair = np.unique(doc * BUCKETS + bucket)
        label = batch.column("label").to_numpy()[pair // BUCKETS]
        for k in (0, 1):
            total[k] += np.bincount(pair[label == k] % BUCKETS, minlength=BUCKETS)
    some = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "n0", "n1"])


def _positions(chosen: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, -1, np.int64)
    out[chosen] = np.arange(len(chosen))
    return out


def features(data: np.ndarray, at: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Presence of the chosen terms: a row for each document."""
    doc, bucket = terms(data, at)
    column = place[bucket]
    known = column >= 0
    out = np.zeros((len(at) - 1, n), np.float32)
    out[doc[known], column[known]] = 1
    return out


def _sample_features(chosen: np.ndarray):
    def run(batches):
        place = _positions(chosen)
        for batch in batches:
            data, at = B.column(batch, "text")
            for lo in range(0, batch.num_rows, 256):
                hi = min(batch.num_rows, lo + 256)
                x = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], place, len(chosen))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32()))], ["doc_id", "label", "has"])

    return run


def margin(x: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The machine's output: bias, weights, and half of (sum squared - squared sum) over factors."""
    inner = x @ factor
    return bias + x @ weight + 0.5 * ((inner**2).sum(1) - (x @ (factor**2)).sum(1))


def train(rows: list[np.ndarray], label: np.ndarray, n: int, steps: int = STEPS, batch: int = 256, rate: float = 0.1, shrink: float = 1e-4, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    bias, weight = float(np.log(share / (1 - share))), np.zeros(n, np.float32)
    factor = rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32)
    seen = [1e-6, np.full(n, 1e-6, np.float32), np.full((n, FACTORS), 1e-6, np.float32)]
    order = np.zeros(0, np.int64)
    for _ in range(steps):
        while len(order) < min(batch, len(rows)):
            order = np.concatenate([order, rng.permutation(len(rows))])
        own, order = order[:batch], order[batch:]
        x = np.zeros((len(own), n), np.float32)
        for i, k in enumerate(own):
            x[i, rows[k]] = 1
        p = 1 / (1 + np.exp(-np.clip(margin(x, bias, weight, factor), -30, 30)))
        error = ((p - label[own]) / len(own)).astype(np.float32)
        inner = x @ factor
        by_weight = x.T @ error + shrink * weight
        by_factor = x.T @ (error[:, None] * inner) - (x.T @ error)[:, None] * factor + shrink * factor
        for k, gradient in enumerate((float(error.sum()), by_weight, by_factor)):
            seen[k] = seen[k] + gradient**2
        bias -= rate * float(error.sum()) / seen[0] ** 0.5
        weight -= rate * by_weight / np.sqrt(seen[1])
        factor -= rate * by_factor / np.sqrt(seen[2])
    return bias, weight, factor


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    sample = cut(labelled(docs, labels, "toxic", PER_LABEL, FOLDS))
    n0, n1 = (sample.groupBy().agg(F.count(F.when(F.col("label") == k, 1)).alias("n")).first()["n"] for k in (0, 1))
    constant = {"bias": 0.0 if not n0 + n1 else float(np.log((n1 + 0.5) / (n0 + 0.5))), "chosen": np.zeros(0, np.int64), "weight": np.zeros(0, np.float32), "factor": np.zeros((0, FACTORS), np.float32)}
    if not n0 or not n1:
        return constant
    counted = sample.select("label", "text").mapInArrow(_bucket_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    cross = a * (n1 - b) - b * (n0 - a)
    chi = n * cross * cross / ((a + b) * (n - a - b) * n0 * n1)
    tested = cut(counted.filter((a + b >= 2) & (a + b <= n - 2)).withColumn("chi", chi))
    chance = 2 * np.log(max(1, tested.count()))
    best = tested.filter(F.col("chi") > float(chance)).orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
    if not best:
        return constant
    chosen = np.array(sorted(r["bucket"] for r in best), np.int64)
    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("has", T.ArrayType(T.IntegerType()))])
    rows = sample.mapInArrow(_sample_features(chosen), schema).toArrow().sort_by("doc_id")
    has = [x.values.to_numpy() for x in rows["has"]]
    bias, weight, factor = train(has, rows["label"].to_numpy().astype(np.float32), len(chosen))
    return {"bias": bias, "chosen": chosen, "weight": weight, "factor": factor}


def _score(model, names: list[str]):
    def run(batches):
        m = model.value
        place = _positions(m["chosen"])
        for batch in batches:
            data, at = B.column(batch, "text")
            for lo in range(0, batch.num_rows, 256):
                hi = min(batch.num_rows, lo + 256)
                x = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], place, len(m["chosen"]))
                y = margin(x, m["bias"], m["weight"], m["factor"]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(1 / (1 + np.exp(-np.clip(y, -30, 30))))], [*names, "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``held_out``, ``score`` and ``predicted``."""
    spark = docs.sparkSession
    ship(spark)
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    model = spark.sparkContext.broadcast(fit(docs, labels))
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(f for f in own.schema if f.name != "text"), T.StructField("score", T.DoubleType())])
    done = own.mapInArrow(_score(model, [*inner, "held_out"]), schema)
    return done.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
