"""Cutting lineage in loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


#: Spark's switch that removes a query's shuffle files when the query ends, not when the driver next collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in spark.checkpoint.dir; only where that is unset a folder of this machine is made.

    A round's shuffle files go as soon as its rows are kept, so a loop's disk does not grow with its rounds' shuffles.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="fieldloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            folder = f"file://{path}"
        spark.sparkContext.setCheckpointDir(folder)
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the switch
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
