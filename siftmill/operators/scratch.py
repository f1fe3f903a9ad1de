"""Intermediate results that are kept in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else that of the context; only on a single machine is a
    temporary folder made where there is neither."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="siftmill-")
            atexit.register(shutil.rmtree, own, True)
            named = f"file://{own}"
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage ended, in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, that no other call uses."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
