"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has 64 bits; 3 differing bits or fewer make a link. Two linked
fingerprints agree on at least ``m - 3`` of ``m`` bit blocks, so each distinct
fingerprint goes to one bucket for each choice of those blocks, and buckets are
compared exactly: bit planes stand vertically, a machine word holds 64
candidates, carry-save counters add a plane to 64 distances at a time, and a
word is abandoned once all of its lanes have passed 3.

Equal fingerprints collapse before anything is compared. A bucket of more than
``TILE`` fingerprints is dealt out as pairs of tiles. A comparison task writes a
spanning tree of what it linked, not its pairs; in a tree no node has more than
three edges, so no key grows hot in the component rounds.

Null, empty and blank texts have fingerprint zero and link like any other. A very
long text is read in parts. Repeated rows share a fingerprint; ties for the least
id go by the hash of the text. Extra columns are carried or left out, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.llm import blocks as B
from prosemill.llm.components import components
from prosemill.llm.shared import cut
from prosemill.session import ship

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a tile, rows of a comparison task, and what a bucket should hold on average at most.
TILE, TASK_ROWS, BUCKET = 4096, 60_000, 64
#: Bytes of a slice that is hashed in numpy, shingles whose bits are counted at once.
LONG, AT_ONCE = 256, 1 << 16
#: The primes of XXH64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = np.uint64(2**64 - 1)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def xxh64(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of ``data``, a step of all of them at a time; slices over ``LONG`` bytes one by one."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in _PRIMES)
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    at, size = B.lanes(data), end - begin
    out = np.full(len(size), (seed + _PRIMES[4]) % 2**64, np.uint64)
    wide = np.flatnonzero((size >= 32) & (size <= LONG))
    if len(wide):
        lanes = [np.full(len(wide), x % 2**64, np.uint64) for x in (seed + _PRIMES[0] + _PRIMES[1], seed + _PRIMES[1], seed, seed - _PRIMES[0])]
        for stripe in range(int(size[wide].max()) // 32):
            live = np.flatnonzero(size[wide] >= 32 * (stripe + 1))
            for k in range(4):
                lanes[k][live] = turn(lanes[k][live] + at[begin[wide[live]] + 32 * stripe + 8 * k] * p2, 31) * p1
        h = sum((turn(v, n) for v, n in zip(lanes, (1, 7, 12, 18))), np.zeros(len(wide), np.uint64))
        for v in lanes:
            h = (h ^ (turn(v * p2, 31) * p1)) * p1 + p4
        out[wide] = h
    out += size.astype(np.uint64)
    place, left = begin + (size & ~31), size & 31
    for step in range(3):
        live = np.flatnonzero(left >= 8 * (step + 1))
        out[live] = turn(out[live] ^ (turn(at[place[live] + 8 * step] * p2, 31) * p1), 27) * p1 + p4
    place, left = place + (left & ~7), left & 7
    live = np.flatnonzero(left >= 4)
    out[live] = turn(out[live] ^ ((at[place[live]] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
    place, left = place + (left & ~3), left & 3
    for step in range(3):
        live = np.flatnonzero(left > step)
        out[live] = turn(out[live] ^ (data[place[live] + step].astype(np.uint64) * p5), 11) * p1
    out ^= out >> np.uint64(33)
    out *= p2
    out ^= out >> np.uint64(29)
    out *= p3
    out ^= out >> np.uint64(32)
    if len(far := np.flatnonzero(size > LONG)):
        raw = data.tobytes()
        out[far] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(begin[far].tolist(), end[far].tolist())), np.uint64, len(far))
    return out


def _set_bits(data: np.ndarray, at: np.ndarray, shingle: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, bytes]:
    """How many shingles of each text set each bit, how many it has, and the last words of the last text, joined.

    A ``whole`` text of fewer words than a shingle is a shingle itself.
    """
    data = _LOWER[data]
    begin, end, pointers = B.words(data, at)
    # words with one space behind each: shingles are slices of that
    inside = ~B.SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    joined = np.where(inside, data, 0x20).astype(np.uint8)[keep]
    begin, end = place[begin], place[end]
    n = np.diff(pointers)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, int(whole)))
    edge = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(pointers[:-1] - edge[:-1], count) + np.arange(edge[-1])
    last = np.minimum(first + shingle - 1, np.repeat(pointers[1:], count) - 1)
    out = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(first), AT_ONCE):
        hi = min(len(first), lo + AT_ONCE)
        bits = np.unpackbits(xxh64(joined, begin[first[lo:hi]], end[last[lo:hi]]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs = np.arange(np.searchsorted(edge, lo, "right") - 1, np.searchsorted(edge, hi, "left"))
        docs = docs[count[docs] > 0]
        out[docs] += np.add.reduceat(bits, np.maximum(edge[docs] - lo, 0), axis=0, dtype=np.int64)
    tail = begin[max(pointers[-2], len(begin) - shingle + 1) :]
    return out, count, joined[tail[0] : end[-1]].tobytes() if len(tail) else b""


def simhashes(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text of a column. A text over ``B.SLICE`` bytes is read in parts that begin with the last words of the part before."""
    out = np.zeros(len(at) - 1, np.uint64)
    for lo, hi in B.slices(at, B.SLICE):
        if at[hi] - at[lo] <= B.SLICE:
            bits, count, _ = _set_bits(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shingle)
        else:
            bits, count, tail = np.zeros((1, 64), np.int64), np.zeros(1, np.int64), b""
            for _, _, a, b in B.pieces(data, at[lo : hi + 1]):
                part = np.concatenate([np.frombuffer(tail + b" ", np.uint8), data[a:b]])
                more, n, tail = _set_bits(part, np.array([0, len(part)]), shingle, whole=False)
                bits, count = bits + more, count + n
            if not count[0] and tail:  # fewer words than a shingle has
                bits, count, _ = _set_bits(np.frombuffer(tail, np.uint8), np.array([0, len(tail)]), shingle)
        out[lo:hi] = (_BITS * (bits * 2 > count[:, None])).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprints(names: list[str]):
    def run(batches):
        for batch in batches:
            fp = simhashes(*B.column(batch, "text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(fp, pa.int64())], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and ``fp`` (the fingerprint as a signed long): one narrow pass."""
    inner = [f"c{i}" for i in range(len(carry))]
    ship(docs.sparkSession)
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(f for f in own.schema if f.name != "text"), T.StructField("fp", T.LongType())])
    return own.mapInArrow(_fingerprints(inner), schema).select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], F.col("fp"))


def _near(diff, valid: np.ndarray) -> np.ndarray:
    """Lanes within the radius. ``diff(plane, words)`` gives the differing lanes of some words; ``valid`` the lanes to test."""
    live = np.flatnonzero(valid)
    over = ~valid[live]
    one, two = np.zeros_like(over), np.zeros_like(over)
    for plane in range(64):
        d = diff(plane, live)
        carry = one & d
        one ^= d
        over |= two & carry
        two ^= carry
        if plane % 8 == 7:
            keep = over != _ALL
            if not keep.all():
                live, one, two, over = live[keep], one[keep], two[keep], over[keep]
                if not len(live):
                    break
    out = np.zeros_like(valid)
    out[live] = ~over
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """64 bit planes of n fingerprints, 64 lanes a word."""
    lanes = -(-len(x) // 64) * 64
    bits = np.zeros((64, lanes), np.uint8)
    bits[:, : len(x)] = np.unpackbits(np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _words(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches by the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        left = label[a] != label[b]
        # both ends hook to the lesser root
        np.minimum.at(label, np.maximum(label[a[left]], label[b[left]]), np.minimum(label[a[left]], label[b[left]]))
        label = label[label]
        a, b = a[left], b[left]
    while (label[label] != label).any():
        label = label[label]
    return label


def link_bucket(x: np.ndarray, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links of one bucket: queries against the planes of all of it."""
    n, planes = len(x), _planes(x)
    width = planes.shape[1]
    label, a, b = np.arange(n), [], []
    for lo in range(0, n, at_once):
        q = np.arange(lo, min(n, lo + at_once))
        w0 = lo // 64  # earlier lanes were queries themselves
        span = width - w0
        asked = np.where((x[q, None] & _BITS) != 0, _ALL, np.uint64(0))
        valid = np.tile(_words(np.ones(n, bool))[w0:], len(q))

        def diff(plane, live):
            return planes[plane, w0 + live % span] ^ asked[live // span, plane]

        found = _near(diff, valid).reshape(len(q), span)
        for i in np.flatnonzero(found.any(axis=1)):
            lanes = _lanes(found[i]) + w0 * 64
            roots = np.unique(label[lanes])
            if len(roots) > 1:
                ends = lanes[np.unique(label[lanes], return_index=True)[1]]
                a.append(np.full(len(ends), q[i]))
                b.append(ends)
                label[np.isin(label, roots)] = roots[0]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_runs(x: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many short runs (equal neighbours in ``run``) at once: planes against the same planes, shifted."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    planes = _planes(x)
    for shift in range(1, len(x)):
        same = run[shift:] == run[:-shift]
        if not same.any():
            break
        other = _planes(x[shift:])
        found = _lanes(_near(lambda plane, live: planes[plane, live] ^ other[plane, live], _words(same)))
        a.append(found)
        b.append(found + shift)
    return np.concatenate(a), np.concatenate(b)


def _compare(key, table):
    bucket = table["bucket"].combine_chunks().to_numpy(zero_copy_only=False)
    x = table["fp"].combine_chunks().to_numpy(zero_copy_only=False)
    order = np.lexsort((x, bucket))
    bucket, x = bucket[order], x[order].view(np.uint64)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(x)]])
    size = hi - lo
    a, b = [], []
    short = np.repeat(size <= 64, size)
    if short.any():
        at = np.flatnonzero(short)
        p, q = link_runs(x[at], bucket[at])
        a.append(at[p])
        b.append(at[q])
    for k in np.flatnonzero(size > 64):
        p, q = link_bucket(x[lo[k] : hi[k]])
        a.append(p + lo[k])
        b.append(q + lo[k])
    values, index = np.unique(x, return_inverse=True)
    a, b = (index[np.concatenate(v)] if v else np.zeros(0, np.int64) for v in (a, b))
    label = _merge(len(values), a, b)
    order = np.argsort(label, kind="stable")
    grouped = label[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(grouped)) + 1])
    start = np.repeat(first, np.diff(np.append(first, len(grouped))))
    place = np.arange(len(grouped)) - start
    child = place > 0
    parent = start + (place - 1) // 2
    signed = values.view(np.int64)
    B.trim()
    return pa.table({"a": signed[order[child]], "b": signed[order[parent[child]]]})


def _blocks(m: int) -> list[int]:
    """Masks of m near-equal bit blocks."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def links(distinct: DataFrame, tile: int = TILE, task_rows: int = TASK_ROWS) -> DataFrame:
    """A forest (a, b) over distinct ``fp`` whose trees are what links of radius 3 join inside each bucket."""
    n = distinct.count()
    m = next(m for m in range(4, 8) if m == 7 or n / 2 ** (64 * (m - RADIUS) / m) <= BUCKET)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum(c)) for c in combinations(_blocks(m), m - RADIUS)]
    keyed = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(k))) for i, k in enumerate(masks)])).alias("key"))
    large = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile))
    some = large.count()
    if some:
        # counted: small enough to send, or joined by a shuffle whose hot keys adaptive execution splits
        keyed = keyed.join(F.broadcast(large) if some <= 100_000 else large, "key", "left")
        parts = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("long")
        own = F.pmod(F.xxhash64("fp", F.lit("tile")), parts)
        keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        keyed = keyed.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    else:
        keyed = keyed.withColumnRenamed("key", "bucket")
    tasks = max(1, -(-n * comb(m, RADIUS) // task_rows))
    units = keyed.withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks)))
    return units.groupBy("task").applyInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``fingerprint`` (16 hex digits), ``component_id``, ``representative``.

    ``component_id`` is the least ``doc_id`` that the document reaches over links, itself included;
    null only if no reached document has an id. The representative is the row with that id (of several
    texts, the one of the least hash; rows equal in both are representatives together).
    """
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    fps = cut(fingerprints(own, [*inner, "id", "hash"]))
    # false sorts before true: an id comes before none
    distinct = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least")))
    labels = components(links(distinct.select("fp")), distinct.select(F.col("fp").alias("node"), F.col("least").alias("name")))
    # cut, so that either side of the last join is an exchange of its own and the rows of one fingerprint can be split
    member = cut(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "least").alias("first")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    return fps.join(member, "fp").select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], digits, F.col("first.id").alias("component_id"), first.alias("representative"))
