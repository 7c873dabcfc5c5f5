"""Helpers shared by the corpus operators: table access, lineage cuts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one where that is unset and driver and executors are one process."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if conf is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="quillmark-ckpt-"))
    return conf or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Small state: cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_MADE: list[str] = []  # where this driver has settled frames, in order


def settle(df: DataFrame) -> DataFrame:
    """Large state: write it once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillmark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _MADE.append(path)
    return out


def drop_settled(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Delete the files of settled frames that no later plan reads, and let Spark's cleaner drop shuffles that nothing refers to: disks would hold them until the driver's next full collection."""
    jvm = spark.sparkContext._jvm
    gc.collect()
    jvm.System.gc()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        if (path := getattr(frame, "_settled_at", None)) is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            if path in _MADE:
                _MADE.remove(path)


def made() -> int:
    """A mark for ``drop_made``."""
    return len(_MADE)


def drop_made(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the files of all frames settled since the mark but those to keep; for use when what they led to has been settled."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = {getattr(f, "_settled_at", None) for f in keep}
    for path in _MADE[since:]:
        if path not in kept:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    _MADE[since:] = [p for p in _MADE[since:] if p in kept]


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any], most: int = 2) -> Any:
    """What ``make`` returns, made once in a Python worker for all of its tasks; the last few keys are held."""
    if key not in _HELD:
        while len(_HELD) >= most:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = make()
    return _HELD[key]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(id, component)``, the component being its smallest id.

    Large-star / small-star contraction: every round is two shuffles with map-side
    combine, and the number of rounds is logarithmic. A hub is never gathered: the
    stars need only a minimum by vertex, joined back to the edges, and the join's
    hot side can be split by adaptive execution. Self-loops are ignored.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    state = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        new = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return roots.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

