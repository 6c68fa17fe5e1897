"""Checkpoints, for which iterative operators use the folder that the session names, and the spreading of small scans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt out to all of them.

    Only for a plain scan, of which the splits are known without running anything; a table with splits enough, that
    is any large one, isn't shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


#: The most bytes of a table that is broadcast for a join; larger ones are shuffled.
SMALL = 64_000_000


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """A table that costs nothing to count, such as a checkpointed one, to be broadcast in the next join if its rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder (spark.checkpoint.dir; in local mode a temporary one if unset) and read from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local-cluster") and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="synapta-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
