"""Python code for the executors, and data written out where all of them read it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that goes to Python, where the session keeps Spark's default of 10,000: rows here are whole texts.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, wherever the driver found it, and keep batches of texts small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not getattr(sc, "_stagewise_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="stagewise"), "stagewise_package")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "stagewise"))
        sc._stagewise_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share, so that lost executors cost no recomputation.

    The folder is spark.checkpoint.dir of the session. Where it is unset, a temporary one serves a local master (tests on
    one machine); on a cluster that is an error, since other executors can't read it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "stagewise-checkpoints"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under the session's checkpoint folder, which all executors share."""
    checkpointed(spark.range(1))  # sets the folder where a local master has none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
