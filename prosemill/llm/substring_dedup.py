"""Substring dedup with fixed-block anchors.

Every 35-word window holds a whole aligned block of 18 words (35 = 2 * 18 - 1),
so a repeated window implies an aligned reference block whose words also start
somewhere else. Three rounds, all keyed by *chunk*, a fixed group of whole
documents of a few megabytes:

1. Each chunk sends the distinct hashes of all its rolling 18-word windows
   (probes) and of its aligned blocks (anchors) to hash buckets. A bucket says
   which anchors a second chunk probes; a repeat inside a chunk is seen there.
2. Hits are extended: every 35-word window that holds a hit anchor asks, by 64
   and 48 bits of two independent hashes of its words, whether another chunk has
   it too.
3. Overlapping repeated windows join into maximal exact repeats; their words go.

A chunk names a hash once however often it holds it, and an answer is a bit for
each question, so a passage that stands in a third of all documents costs each
chunk one question and no pair of documents is ever written. The text is
shuffled once; rounds 2 and 3 reuse that exchange.

Null, empty and blank texts have no words. Repeated rows count as occurrences of
each other; where one id and text is repeated more than ``REPEATED`` times, rows
are dealt to chunks by their place too, and that is written down first. Columns
beside ``doc_id`` and ``text`` are carried, whatever their names. A text longer
than a chunk makes a chunk of that length; its words are hashed in parts. All
occurrences of a window go, so there are no ties. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm import blocks as B
from prosemill.llm.shared import chunks, power_of_two
from prosemill.session import ship

WINDOW = 35
#: Text bytes of a chunk, on average.
CHUNK = 4 << 20
#: Hashes that a bucket of round 1 gets, about.
BUCKET = 2_000_000
_ASK = "chunk long, bucket int, one binary, two binary"
_ANSWER = "chunk long, bucket int, bits binary"


class _Chunk:
    """Hashes of a chunk's words and windows; the same for the same documents in any order of rounds."""

    def __init__(self, table: pa.Table, window: int, bits: int, exponent: int):
        self.window, self.block, self.bits, self.exponent = window, (window + 1) // 2, bits, exponent
        self.data, self.at = B.column(table, "text")
        self.words, self.pointers = B.hashed(self.data, self.at)
        n = len(self.words)
        sizes = np.diff(self.pointers)
        held = B.window_starts(self.pointers, self.block, n) & np.repeat(sizes >= window, sizes)
        roll = B.rolling(self.words, self.block) >> np.uint64(64 - bits)
        self.probes, counts = np.unique(roll[held[: len(roll)]], return_counts=True)
        place = (np.arange(n, dtype=np.int32) - np.repeat(self.pointers[:-1].astype(np.int32), sizes)) % self.block
        self.anchor_at = np.flatnonzero(held & (place == 0))
        del held, place
        self.anchor_of = roll[self.anchor_at]
        self.anchors = np.unique(self.anchor_of)
        self.twice = counts[np.searchsorted(self.probes, self.anchors)] > 1
        self.long = B.window_starts(self.pointers, window, n)

    def answered(self, values: np.ndarray, bits: int, answers: dict[int, bytes], own: np.ndarray) -> np.ndarray:
        """Own knowledge, and the bits that buckets sent about ascending values."""
        out = own.copy()
        buckets, edge = B.bucket_edges(values, bits, self.exponent)
        for bucket, lo, hi in zip(buckets.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            if bucket in answers:
                out[lo:hi] |= np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=hi - lo).astype(bool)
        return out

    def extend(self, answers: dict[int, bytes]) -> None:
        """The windows that hold a hit anchor: ``start`` by ``order`` gives ``one``, ``two``, ascending and distinct."""
        hit = self.answered(self.anchors, self.bits, answers, self.twice)
        at = self.anchor_at[hit[np.searchsorted(self.anchors, self.anchor_of)]]
        n = len(self.words)
        near = np.zeros(n + 1, np.int32)
        np.add.at(near, np.maximum(at - (self.window - self.block), 0), 1)
        np.add.at(near, at + 1, -1)
        start = np.flatnonzero((np.cumsum(near[:-1]) > 0) & self.long)
        one = B.rolling(self.words, self.window)[start] if len(start) else np.zeros(0, np.uint64)
        two = B.rolling(B.hashed(self.data, self.at, seed=1)[0], self.window, 1)[start] >> np.uint64(16) if len(start) else one
        order = np.lexsort((two, one))
        start, one, two = start[order], one[order], two[order]
        new = np.ones(len(start), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.start, self.group = start, np.cumsum(new) - 1
        self.one, self.two = one[new], two[new]
        self.several = np.bincount(self.group, minlength=len(self.one)) > 1

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which words repeated windows cover."""
        repeated = self.answered(self.one, 64, answers, self.several)
        at = self.start[repeated[self.group]] if len(self.start) else self.start
        cover = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    B.trim()
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_ASK_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: bits for b, bits, k in zip(table["bucket"].to_pylist(), table["bits"].to_pylist(), table["round"].to_pylist()) if k == kind}


def _probe(window, bits, exponent):
    def ask(key, table):
        c = _Chunk(table, window, bits, exponent)
        buckets, p = B.bucket_edges(c.probes, bits, exponent)
        a = np.append(np.searchsorted(c.anchors, buckets.astype(np.uint64) << np.uint64(bits - exponent)), len(c.anchors))  # anchors are probes too
        return _rows(_ASK_ARROW, [(key[0].as_py(), b, B.pack(c.probes[p[i] : p[i + 1]], b << (bits - exponent)), B.pack(c.anchors[a[i] : a[i + 1]], b << (bits - exponent))) for i, b in enumerate(buckets.tolist())])

    return ask


def _match(bits, exponent):
    def answer(key, table):
        base = key[0].as_py() << (bits - exponent)
        every = np.sort(np.concatenate([B.unpack(x.as_py(), base) for x in table["one"]]))
        out = []
        for chunk, blob in zip(table["chunk"].to_pylist(), table["two"]):
            a = B.unpack(blob.as_py(), base)
            several = np.searchsorted(every, a, "right") - np.searchsorted(every, a, "left") > 1
            if several.any():
                out.append((chunk, key[0].as_py(), np.packbits(several).tobytes()))
        return _rows(_ANSWER_ARROW, out)

    return answer


def _extend(window, bits, exponent):
    def ask(key, table, answers):
        c = _Chunk(table, window, bits, exponent)
        c.extend(_answers(answers, 1))
        buckets, e = B.bucket_edges(c.one, 64, exponent)
        return _rows(_ASK_ARROW, [(key[0].as_py(), b, B.pack(c.one[lo:hi]), c.two[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for b, lo, hi in zip(buckets.tolist(), e[:-1].tolist(), e[1:].tolist())])

    return ask


def _confirm(key, table):
    ones = [B.unpack(x.as_py()) for x in table["one"]]
    one, twos = np.concatenate(ones), []
    for x in table["two"]:
        wide = np.zeros((len(x.as_py()) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6)
        twos.append(wide.reshape(-1).view("<u8"))
    two = np.concatenate(twos)
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    several = np.zeros(len(one), bool)
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    out, lo = [], 0
    for chunk, x in zip(table["chunk"].to_pylist(), ones):
        own = several[lo : lo + len(x)]
        lo += len(x)
        if own.any():
            out.append((chunk, key[0].as_py(), np.packbits(own).tobytes()))
    return _rows(_ANSWER_ARROW, out)


def kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, each of them with the spaces up to the next word; other spaces stay."""
    data = np.frombuffer(text, np.uint8)
    begin, _, _ = B.words(data, np.array([0, len(data)]))
    cuts = np.append(begin, len(data))
    out, lo = [text[: cuts[0]]], 0
    change = np.flatnonzero(np.diff(gone.astype(np.int8))) + 1
    for lo, hi in zip([0, *change], [*change, len(gone)]):
        if not gone[lo]:
            out.append(text[cuts[lo] : cuts[hi]])
    return b"".join(out)


def _finish(window, bits, exponent, names, with_text, arrow):
    def finish(key, table, answers):
        c = _Chunk(table, window, bits, exponent)
        c.extend(_answers(answers, 1))
        gone = c.removed(_answers(answers, 2))
        text, n, removed, digest = [], [], [], []
        for i in range(table.num_rows):
            raw, lo, hi = c.data[c.at[i] : c.at[i + 1]].tobytes(), c.pointers[i], c.pointers[i + 1]
            own = gone[lo:hi]
            kept = raw.split()
            if own.any():
                kept = [w for w, g in zip(kept, own) if not g]
            n.append(hi - lo)
            removed.append(int(own.sum()))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            if with_text:
                text.append(kept_text(raw, own).decode() if own.any() else None)
        del c, gone
        B.trim()
        out = [table[x] for x in names]
        if with_text:
            was = table["text"].to_pylist()
            out.append(pa.array([t if t is not None else w for t, w in zip(text, was)], pa.string()))
        return pa.table([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (*out, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()))], names=arrow)

    return finish


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Each document with ``n_words``, ``n_removed``, ``kept_sha256`` and, ``with_text``, its ``text`` without repeated windows.

    ``carry`` names the columns to keep (all but ``text`` if None). A text that loses nothing stays as it was.
    """
    ship(docs.sparkSession)
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    # the operator's own columns have names of its own, so columns of any name can be carried
    own, size = chunks(docs, dict(zip(inner, carry)), CHUNK)
    exponent = max(3, power_of_two(size / 6 / BUCKET))
    bits = min(60, max(40, power_of_two(size / 6 + 1) + 10))
    grouped = own.groupBy("chunk")
    ask = grouped.applyInArrow(_probe(window, bits, exponent), _ASK)
    hits = ask.groupBy("bucket").applyInArrow(_match(bits, exponent), _ANSWER).withColumn("round", F.lit(1))
    more = grouped.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(window, bits, exponent), _ASK)
    repeats = more.groupBy("bucket").applyInArrow(_confirm, _ANSWER).withColumn("round", F.lit(2))
    types = {f.name: f.dataType.simpleString() for f in own.schema}
    names = [*inner, *(["text"] if with_text else []), "n_words", "n_removed", "kept_sha256"]
    schema = ", ".join([*(f"{x} {types[x]}" for x in inner), *(["text string"] if with_text else []), "n_words long, n_removed long, kept_sha256 string"])
    done = grouped.cogroup(hits.unionByName(repeats).groupBy("chunk")).applyInArrow(_finish(window, bits, exponent, inner, with_text, names), schema)
    return done.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], *names[len(inner) :])
