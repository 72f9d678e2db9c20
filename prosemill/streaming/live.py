"""Live documents: the latest text of each uri, analyzed again whenever it changes.

Events are (uri, version, text, op) with op ``open``, ``change``, ``save`` or ``close``. A micro-batch
keeps the last event of each uri, so work follows the number of changed documents; a close
retracts by an empty row of counts. State lives in the sink table of the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill import config as C
from prosemill.operators.prose import findings

AGENT_FILES = r"(?i)(?:^|/)(?:agents|claude|copilot-instructions)\.md$"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each uri: by version, then by arrival."""
    return events.groupBy("uri").agg(F.max_by(F.struct("version", "text", "op"), F.struct("version", "arrived")).alias("x")).select("uri", "x.*")


def analyzed(events: DataFrame, cfg: C.Config | None = None) -> DataFrame:
    """(uri, version, detector, category, ...) of documents that are open; agent instructions are left out."""
    now = latest(events.filter(~F.col("uri").rlike(AGENT_FILES)))
    open_ = now.filter("op <> 'close'").select("uri", "version", "text")
    return findings(open_, cfg, keep=("uri", "version"))


def changes(events: DataFrame, cfg: C.Config | None = None) -> DataFrame:
    """One row for each changed document, closed ones with no findings: (uri, version, n_findings)."""
    now = latest(events.filter(~F.col("uri").rlike(AGENT_FILES))).select("uri", "version")
    counts = analyzed(events, cfg).groupBy("uri").agg(F.count("*").alias("n"))
    return now.join(counts, "uri", "left").select("uri", "version", F.coalesce("n", F.lit(0)).alias("n_findings"))


def watch(events: DataFrame, publish: Callable[[DataFrame, int], None], cfg: C.Config | Callable[[], C.Config] | None = None, checkpoint: str | None = None):
    """Starts a query over a stream of events; ``publish`` gets each batch's rows and its number.

    A callable configuration is read again for every batch, so rules can change while the stream runs.
    """

    def run(batch: DataFrame, number: int) -> None:
        publish(changes(batch, cfg() if callable(cfg) else cfg), number)

    writer = events.writeStream.foreachBatch(run).outputMode("update")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
