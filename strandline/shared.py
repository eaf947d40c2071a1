"""Helpers of the session: the folder that driver and executors share, and joins with small tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast; a larger one is joined as it is.
SMALL = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master, as in tests, may leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master or ""
    if master == "local" or master.startswith("local["):
        return "/tmp/checkpoints/strandline"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the driver exits: DataFrames that were returned may still read it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove():
        with contextlib.suppress(Exception):  # a session that has ended
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(remove)
    return path


def small(df: DataFrame, most: int = SMALL, text: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and, of a column ``text``, at most so many bytes."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    return F.broadcast(df) if n <= most and (size or 0) <= most_bytes else df
