"""Results that several later plans read, written once where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and driver and executors are one process."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if conf is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="quillmark-ckpt-"))
    return conf or sc.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """The rows, computed now and read back from a reliable checkpoint by every later plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
