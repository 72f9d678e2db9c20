"""Sharding: minimax contiguous partition of ordered atomic groups (law ``bytes``).

Rows of equal texts are one atomic group; groups stand in the order of a 64-bit
hash of their text. The smallest feasible shard capacity is found by binary
search, a greedy fill checking each candidate, and the order is cut there.

The groups never reach the driver. It sees sums over ranges of the hash: first
of 1,024 ranges, then of those ranges again in which some candidate capacity
could still cut, each split a thousandfold, until what is left is a bounded
number of single groups (``FINE``). Ranges in which no cut can fall stay whole,
so the search over what it sees gives the exact capacity.

A group larger than an even share of what is left has a shard of its own (fewer
than ``shards`` groups can), since no cut can make its shard smaller and the
others are then filled evenly.

Null text has no bytes and stands with empty texts. A very long text is a group
as any other. Repeated rows are rows of one group. Groups whose 64-bit text hash
is equal are one. Fewer groups than shards leave shards empty; an empty table
gives an empty result. Slots number a shard's rows from 0 without gaps: rows are
dealt to ``LANES`` lanes by a hash of their id, text and place in the table (a row
repeated without end fills no lane), which is written down once; lanes are
numbered inside, and the counts of the lanes before are added. Extra columns are
carried or left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.shared import cut

SHARDS = 24
LANES = 512
#: Single groups that the search may look at, and hash bits by which a range is split.
FINE, STEP_BITS = 200_000, 10


def greedy(edges: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Piece numbers after which a greedy fill cuts; None if ``shards`` don't suffice. ``edges`` are sums up to each piece, from 0."""
    cuts, at = [], 0
    while at < len(edges) - 1:
        to = int(np.searchsorted(edges, edges[at] + capacity, "right")) - 1
        if to == at or len(cuts) == shards:
            return None
        cuts.append(to)
        at = to
    return cuts


def least_capacity(edges: np.ndarray, low: int, shards: int) -> int:
    """The smallest capacity from ``low`` up that a greedy fill of these pieces meets."""
    high = int(edges[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(edges, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _open(edges: np.ndarray, low: int, high: int, most: int, shards: int) -> np.ndarray:
    """Which pieces a cut of some capacity from ``low`` to ``high`` can split."""
    out = np.zeros(len(edges) - 1, bool)
    least = furthest = 0
    for _ in range(shards):
        reach = least + low
        least = max(reach - most, int(edges[np.searchsorted(edges, reach, "right") - 1]) if reach <= edges[-1] else int(edges[-1]))
        furthest = min(int(edges[-1]), furthest + high)
        out |= (edges[1:] > least) & (edges[:-1] < furthest)
        if least >= edges[-1]:
            break
    return out


def boundaries(groups: DataFrame, total: int, most: int, shards: int, fine: int = FINE) -> list[int]:
    """Keys at which shards after the first begin. ``groups``: (key long, bytes long), keys distinct."""
    if not total:
        return []
    shift = 64 - STEP_BITS
    level = groups.groupBy(F.shiftright("key", shift).alias("r")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).orderBy("r").collect()
    pieces = [(r["r"] << shift, r["b"], r["n"], shift) for r in level]  # (first key, bytes, groups, bits below)
    while True:
        edges = np.concatenate([[0], np.cumsum([p[1] for p in pieces], dtype=np.int64)])
        low = max(most, -(-total // shards))
        high = least_capacity(edges, low, shards)
        wide = [i for i in np.flatnonzero(_open(edges, low, high, most, shards)) if pieces[i][2] > 1]
        if not wide:
            break
        split: dict[int, list[tuple]] = {}
        if sum(pieces[i][2] for i in wide) <= fine:
            for shift in {pieces[i][3] for i in wide}:
                own = [pieces[i][0] >> shift for i in wide if pieces[i][3] == shift]
                for r in groups.filter(F.shiftright("key", shift).isin(own)).orderBy("key").collect():
                    split.setdefault(r["key"] >> shift << shift, []).append((r["key"], r["bytes"], 1, 0))
        else:
            for shift in {pieces[i][3] for i in wide}:
                own, below = [pieces[i][0] >> shift for i in wide if pieces[i][3] == shift], max(0, shift - STEP_BITS)
                found = groups.filter(F.shiftright("key", shift).isin(own)).groupBy(F.shiftright("key", below).alias("r")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
                for r in found.orderBy("r").collect():
                    split.setdefault((r["r"] << below) >> shift << shift, []).append((r["r"] << below, r["b"], r["n"], below))
        chosen = set(wide)
        pieces = [q for i, p in enumerate(pieces) for q in (split[p[0]] if i in chosen else [p])]
    cuts = greedy(edges, least_capacity(edges, low, shards), shards)
    return [pieces[c][0] for c in cuts[:-1]]


def assign(docs: DataFrame, shards: int = SHARDS, lanes: int = LANES, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], F.pmod(F.xxhash64("doc_id", text, F.monotonically_increasing_id()), F.lit(lanes)).alias("lane"), F.xxhash64(F.lit("order"), "doc_id").alias("turn"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    most = 0
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if len(alone) + 1 < shards and r["bytes"] * (shards - len(alone)) > total:
            alone.append(r["key"])
            total -= r["bytes"]
        else:
            most = r["bytes"]
            break
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    starts = boundaries(rest, total, most, shards - len(alone))
    shard = F.lit(len(alone))
    for s in starts:
        shard = shard + (F.col("key") >= s).cast("int")
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == k, F.lit(i)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard and lane, so it can be sent
    offsets = placed.groupBy("shard", "lane").count().select("shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("turn", "key"))
    out = placed.withColumn("place", inside).join(F.broadcast(offsets), ["shard", "lane"])
    return out.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
