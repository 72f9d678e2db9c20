"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Rows of an Arrow batch where the session has Spark's default: texts are long, and a batch stands in several buffers at once.
BATCH_ROWS, SPARK_ROWS = 1_000, "10000"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors through Spark's own file server, once for each application, and keeps Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARK_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="prosemill-")) / "prosemill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, dealt out anew if it lies in fewer parts than half the cores.

    A small file can be one row group, which one task reads however many splits it has; work on texts is worth a
    shuffle of it. Tables of more splits than twice the cores are left alone, so what is shuffled is bounded.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() > 2 * cores:
        return df
    filled = df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    return df.repartition(2 * cores) if 2 * filled < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only in local mode without that setting."""
    context = spark.sparkContext
    if known := context.getCheckpointDir():
        return known
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="prosemill-checkpoint-")
    context.setCheckpointDir(told)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder; its lineage ends there, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
