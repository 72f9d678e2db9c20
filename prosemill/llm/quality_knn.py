"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are hashed pairs of neighbouring bytes: they see scripts,
capitals, symbols and separators alike in any language. A word that repeats the
one before it adds to each of ``ECHOES`` terms kept for that. Counts are damped, weighted by inverse document frequency and projected onto ``DIMENSIONS``
singular vectors of the labelled sample. The labelled vectors are broadcast;
every document's cosines with all of them are taken exactly, a block of
documents at a time, and the labels of the nearest vote, weighted by a power of
their cosine.

The classifier is fitted on a bounded sample of labelled rows: ``PER_LABEL`` of
each label, those of the least id hashes, taken from the learning folds alone.
Documents pass through two narrow scans; nothing of theirs is shuffled.

Null, empty and one-byte texts have no terms: they score the sample's mean
label. Neighbours as near as the last of the nearest vote too, so ties need no
order. A label that is repeated counts once, as 1 if any of its rows is; of
several texts of one id the one of the least hash is learned from; labels of
absent ids count for nothing. Without labels every score is 0.5. Very long texts
are read in parts. Repeated rows each get their score. Ids are of any type; extra
columns are carried or left out, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.llm import blocks as B
from prosemill.llm.shared import crc_mod
from prosemill.session import ship

PER_LABEL = 2048
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 64, 25, 4
ECHOES = 16
FOLDS, THRESHOLD = 5, 0.3
#: Documents of a block, bytes whose terms are counted at once.
BLOCK, PIECE = 256, 1 << 20


def term_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed byte pairs, then of repeated words: a row for each document."""
    n = len(at) - 1
    out = np.zeros(n * TERMS, np.float32)
    for lo, hi in B.slices(at, PIECE):
        for a in range(int(at[lo]), int(at[hi]), PIECE):
            b = min(a + PIECE + 1, int(at[hi]))  # one byte over, so that no pair is missed
            x = data[a:b].astype(np.uint32)
            if len(x) < 2:
                continue
            term = ((x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)) >> np.uint32(8)).astype(np.int64) % (TERMS - ECHOES)
            doc = np.searchsorted(at[lo : hi + 1], np.arange(a, b - 1), "right") - 1 if hi > lo + 1 else np.zeros(len(term), np.int64)
            whole = np.ones(len(term), bool)
            last = at[lo + 1 : hi] - 1 - a  # a pair that spans two documents
            whole[last[(last >= 0) & (last < len(term))]] = False
            found = np.bincount((doc * TERMS + term)[whole], minlength=(hi - lo) * TERMS)
            out[lo * TERMS : hi * TERMS] += found
    out = out.reshape(n, TERMS)
    word, pointers = B.hashed(data, at)
    again = np.zeros(len(word) + 1, np.int64)
    again[2:] = np.cumsum(word[1:] == word[:-1]) if len(word) else 0
    first = np.minimum(pointers[:-1] + 1, pointers[1:])  # a first word repeats none
    out[:, TERMS - ECHOES :] = (again[pointers[1:]] - again[first])[:, None]
    return out


def _sample_terms(batches):
    for batch in batches:
        data, at = B.column(batch, "text")
        for lo in range(0, batch.num_rows, BLOCK):
            hi = min(batch.num_rows, lo + BLOCK)
            counts = term_counts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            terms = [np.flatnonzero(r) for r in counts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([t.astype(np.int32) for t in terms], pa.list_(pa.int32())), pa.array([r[t] for r, t in zip(counts, terms)], pa.list_(pa.float32()))], ["doc_id", "label", "terms", "counts"])


def labelled(docs: DataFrame, labels: DataFrame, name: str, per_label: int | dict[int, int], folds: int = FOLDS) -> DataFrame:
    """(doc_id, label, text) of a bounded sample of each label's rows from the learning folds."""
    own = labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != 0)).groupBy("doc_id").agg((F.max(name) > 0).cast("int").alias("label"))
    parts = [own.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label if isinstance(per_label, int) else per_label[k]) for k in (0, 1)]
    # bounded by the limits, so it can be sent
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "label", "x.text")


def latent(counts: np.ndarray, dimensions: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(idf, terms by dimensions): the leading right singular vectors, by a randomized range finder."""
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = weigh(counts, idf)
    k = min(dimensions, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return idf, np.ascontiguousarray((q @ vt.T)[:, :k])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def vote(z: np.ndarray, known: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """The label mean of the nearest, weighted by powers of their cosines."""
    cosine = np.maximum(z @ known.T, 0)
    k = min(NEIGHBOURS, len(known))
    last = np.partition(cosine, len(known) - k, axis=1)[:, len(known) - k]
    weight = np.where(cosine >= last[:, None], cosine, 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 0, weight @ label / np.maximum(total, 1e-300), prior)


def _score(model, names: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            data, at = B.column(batch, "text")
            for lo in range(0, batch.num_rows, BLOCK):
                hi = min(batch.num_rows, lo + BLOCK)
                if m is None:
                    s = np.full(hi - lo, 0.5)
                else:
                    counts = term_counts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    s = vote(unit(weigh(counts, m["idf"]) @ m["base"]), m["known"], m["label"], m["prior"])
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in names), pa.array(np.clip(s, 0, 1), pa.float64())], [*names, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, folds: int = FOLDS) -> dict | None:
    sample = labelled(docs, labels, "quality", per_label, folds)
    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])
    rows = sample.mapInArrow(_sample_terms, schema).toArrow()  # 2 * per_label rows at most
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id")
    counts = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (t, c) in enumerate(zip(rows["terms"], rows["counts"])):
        counts[i, t.values.to_numpy()] = c.values.to_numpy()
    label = rows["label"].to_numpy().astype(np.float64)
    idf, base = latent(counts, DIMENSIONS)
    return {"idf": idf, "base": base, "known": unit(weigh(counts, idf) @ base), "label": label, "prior": float(label.mean())}


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``held_out``, ``score`` and ``predicted``."""
    spark = docs.sparkSession
    ship(spark)
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    model = spark.sparkContext.broadcast(fit(docs, labels, per_label))
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(f for f in own.schema if f.name != "text"), T.StructField("score", T.DoubleType())])
    done = own.mapInArrow(_score(model, [*inner, "held_out"]), schema)
    return done.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
