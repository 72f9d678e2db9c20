"""Session helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.session import checkpoint_dir, cut  # noqa: F401  operators take them from here

#: Java regex of the word separators of most contracts: space and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of one id and text that may stand in one chunk.
REPEATED = 1_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take the quicker built-in."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of the texts: one pass, one row back."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0


def chunks(docs: DataFrame, named: dict[str, str], chunk_bytes: int, **more: Column) -> tuple[DataFrame, int]:
    """(rows with ``text`` and ``chunk``, the texts' bytes). ``named``: new names of columns to take along.

    A chunk is a set of whole documents that an operator takes at once, by the hash of id and text, so that each round
    finds the same chunks. A row that is repeated more than ``REPEATED`` times would fill one chunk: then rows are
    dealt by their place in the table, which is written down because no second reading need find the same places.
    """
    text = F.col("text").cast("string")
    key = F.xxhash64("doc_id", text)
    counted = docs.select(key.alias("k"), F.octet_length(text).alias("b")).groupBy("k").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    told = counted.agg(F.sum("b").alias("b"), F.max("n").alias("n")).first()
    size, hot = told["b"] or 0, (told["n"] or 0) > REPEATED
    chunk = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()) if hot else key, F.lit(max(32, -(-size // chunk_bytes))))
    own = docs.select(*[F.col(f"`{c}`").alias(x) for x, c in named.items()], *[c.alias(x) for x, c in more.items()], text.alias("text"), chunk.alias("chunk"))
    return cut(own) if hot else own, size


def cut_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``cut``, in partitions by a column and sorted by it, so that grouping by it later shuffles nothing.

    Adaptive execution forgets the partitioning of what is written down, and a join takes a side as it lies only if
    that has as many partitions as the session gives a shuffle.
    """
    conf = df.sparkSession.conf
    was, least = conf.get("spark.sql.adaptive.enabled"), int(conf.get("spark.sql.shuffle.partitions"))
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(max(parts, least), key).sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def power_of_two(n: float) -> int:
    """The exponent of the least power of two that is n at least."""
    return max(0, int(-(-n // 1) - 1).bit_length())
