"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations alone.

Logs often hold a conversation several times, each time with more turns. Every
turn gets two hashes of its place, role and text; their running exclusive or is
the hash of each turn prefix. A conversation goes if its whole hash is a proper
prefix of another, and of conversations with equal turns the least id stays.
The rest are rendered as ``<|role|>`` lines.

Prefix hashes are distinct before they are joined and whole hashes are grouped
first, so a first turn or a conversation that a third of the log shares is one
row on either side of the anti-join. Texts are shuffled once, by conversation.

Null role and text count and render as empty. Turns are ordered by (turn, hashes),
nulls first, so ties have one order whatever the order of rows. A turn that
repeats the one before it in all columns counts once. A row without a ``conv_id``
is a conversation of its own (all such rows together could be a third of the
log); equal ones count once. A very long conversation is one group, as its
rendered text is one value. Other columns are left out, whatever their names. An
empty table gives an empty result. Conversations are equal if both 64-bit hashes
of their turns and their lengths are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a conversation is known by: its id, or the hash of a turn without one.
KEY = ["conv_id", "solo"]


def _placed(turns: DataFrame, extra: list[str]) -> DataFrame:
    """Turns in order: ``k`` from 1, without immediate repeats."""
    order = Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("turn"), "h", "g")
    same = F.lag(F.struct("turn", "h", "g")).over(order).eqNullSafe(F.struct("turn", "h", "g"))
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    own = turns.select("conv_id", "turn", F.xxhash64(role, text).alias("h"), F.xxhash64(text, F.lit("|"), role).alias("g"), *extra)
    own = own.withColumn("solo", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "h", "g")))
    return own.withColumn("same", same).filter(~F.col("same")).withColumn("k", F.row_number().over(order)).drop("same")


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, solo, n_turns, n_copies) of maximal conversations."""
    running = Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.partitionBy(*KEY).orderBy("k")
    prefix = _placed(turns, []).select(
        *KEY,
        "k",
        F.bit_xor(F.xxhash64("k", "h", "g")).over(running).alias("p"),
        F.bit_xor(F.xxhash64("g", "h", "k")).over(running).alias("q"),
        F.lead("k").over(last).isNull().alias("whole"),
    )
    # false sorts before true: an id comes before none
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), *KEY)).alias("first")
    whole = prefix.filter("whole").groupBy("k", "p", "q").agg(first, F.count("*").alias("n_copies"))
    proper = prefix.filter("NOT whole").select("k", "p", "q").distinct()
    return whole.join(proper, ["k", "p", "q"], "left_anti").select("first.conv_id", "first.solo", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of maximal conversations."""
    turns = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = collapse(turns).withColumnRenamed("conv_id", "kept_id").withColumnRenamed("solo", "kept_solo")
    own = _placed(turns, ["role", "text"]).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")) & F.col("solo").eqNullSafe(F.col("kept_solo")))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = own.groupBy(*KEY).agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
