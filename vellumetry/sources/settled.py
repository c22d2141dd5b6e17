"""Cutting lineage where each round reads the one before."""

from __future__ import annotations

import tempfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

#: Where the rows of a frame are held.
_FILES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settled(df: DataFrame) -> DataFrame:
    """df, computed and held in the checkpoint folder that all executors share; in a folder of our own where none is set and
    Spark is local, as in tests.

    The result is a frame anew over the held rows.  A checkpoint keeps the guessed size of what it came from, and that of a join
    is the product of its sides': after some rounds the guess alone, a number of many million digits, fills the driver."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellumetry-checkpoint-"))
    held = df.checkpoint()._jdf
    out = DataFrame(spark._jsparkSession.createDataFrame(held.javaRDD(), held.schema()), spark)
    _FILES[out] = held.queryExecution().logical().rdd().getCheckpointFile().get()
    return out


def unsettled(*frames: DataFrame) -> None:
    """Deletes what settled() holds of frames that no result and no later round still reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_FILES.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
