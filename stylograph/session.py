"""Session settings and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stylograph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and all of Spark runs in one process, as in tests, a folder
    of this machine is used, and removed at the end; a cluster has to name one that all its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
            folder = tempfile.mkdtemp(prefix="stylograph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, over all cores where its files give fewer partitions, as those of one row group do; large inputs stay as they are.

    For work on a row that outweighs moving it once. Filters and column pruning pass through. Only for plain scans: other plans would
    be run to count their partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def evened(df: DataFrame, *by: str) -> DataFrame:
    """A table as read, as ``spread`` gives it, and over as many partitions as its scan has where one of them holds more than two
    cores' share of the rows: a row group is never divided, so files of one large row group leave all work to a few tasks.

    Rows are counted in the files' footers; they are moved by the hash of the columns ``by``, which should tell most rows apart.
    """
    made = spread(df)
    if made is not df:
        return made
    most, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    uneven = most and most * df.sparkSession.sparkContext.defaultParallelism > 2 * rows
    return df.repartition(df.rdd.getNumPartitions(), F.xxhash64(*by)) if uneven else df
