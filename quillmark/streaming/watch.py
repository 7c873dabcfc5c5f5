"""Watching a note folder.

A file source reports neither edits nor deletions, so every trigger takes a snapshot of
the notes, compares its hashes with those of the last one by a full outer join, and hands
on the changes together with the notes of that same snapshot. Every trigger reads the
whole folder; ``sources.changes`` reads what changed only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.sources.notes import read_notes


def snapshot(notes: DataFrame) -> DataFrame:
    return notes.select("relative_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``relative_path, change``: added, changed or deleted."""
    a, b = before.withColumnRenamed("content_sha256", "old"), now.withColumnRenamed("content_sha256", "new")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "relative_path", "full_outer").select("relative_path", kind.alias("change")).where("change IS NOT NULL")


def watch(spark: SparkSession, folder: str, on_change: Callable[[DataFrame, DataFrame, int], None], state_dir: str, seconds: int = 5) -> StreamingQuery:
    """Starts a query that calls ``on_change(changes, notes, batch_id)`` whenever notes change.

    Snapshots are kept as Parquet in ``state_dir``, a folder that all executors share,
    one for each batch, so a restart goes on from the last one that was finished. A batch
    that fails is repeated against the same earlier snapshot; older ones are deleted. A
    snapshot is marked once ``on_change`` has returned, so a batch that is repeated only
    because the query was stopped before Spark noted its end does not hand on its changes again.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def place(batch: int):
        where = jvm.org.apache.hadoop.fs.Path(f"{state_dir.rstrip('/')}/snapshot-{batch}")
        return where.getFileSystem(conf), where

    def mark(batch: int):
        return jvm.org.apache.hadoop.fs.Path(f"{state_dir.rstrip('/')}/snapshot-{batch}/_handed_on")

    def step(_: DataFrame, batch: int) -> None:
        files, done = place(batch)
        if files.exists(mark(batch)):  # what it found is known: it becomes the earlier snapshot
            files.delete(place(batch - 1)[1], True)
            if not files.rename(done, place(batch - 1)[1]):
                raise RuntimeError(f"can't rename {done.toString()}")
        notes = read_notes(spark, folder)
        path = f"{state_dir.rstrip('/')}/snapshot-{batch}"
        notes.withColumn("content_sha256", F.sha2(F.coalesce("content", F.lit("")), 256)).write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        files, before = place(batch - 1)
        last = spark.read.parquet(before.toString()) if files.exists(before) else now.limit(0)
        delta = changes(last.select("relative_path", "content_sha256"), now.select("relative_path", "content_sha256"))
        if not delta.isEmpty():
            on_change(delta, now, batch)
            files.create(mark(batch)).close()
        files, old = place(batch - 2)
        files.delete(old, True)

    return ticks.writeStream.foreachBatch(step).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", f"{state_dir.rstrip('/')}/checkpoint").start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream (or table) by type and tumbling window, late rows dropped after the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
