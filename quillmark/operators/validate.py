"""Validation: reports over diagnostics, the severity gate, duplicate identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.vocabulary import GATE, IDENTITY_DUPLICATE


def with_prefix(diagnostics: Column, prefix: str) -> Column:
    return F.filter(diagnostics, lambda d: d["code"].startswith(prefix))


def report(projection: DataFrame) -> DataFrame:
    """A row for each diagnostic."""
    # the outer form, as the inner one has the optimizer filter by a second copy of the whole projection
    rows = projection.select("relative_path", F.explode_outer("diagnostics").alias("d"))
    return rows.where("d IS NOT NULL").select("relative_path", "d.*")


def summary(projection: DataFrame) -> DataFrame:
    return report(projection).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def joined(diagnostics: Column) -> Column:
    return F.array_join(F.transform(diagnostics, lambda d: F.concat(d["code"], F.lit(": "), d["message"])), "\n")


def gate(projection: DataFrame) -> DataFrame:
    """One row: notes, diagnostics that fail the gate, exit code."""
    bad = F.size(F.filter("diagnostics", lambda d: d["severity"].isin(*GATE)))
    return projection.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("failures")).withColumn("exit_code", (F.col("failures") > 0).cast("int"))


def duplicate_identities(projection: DataFrame) -> DataFrame:
    """uids that several notes bear: counted with map-side combine, no list of notes."""
    by = projection.where("authored.uid IS NOT NULL").groupBy(F.col("authored.uid").alias("uid"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("relative_path").alias("first_path")).where("n > 1").withColumn("code", F.lit(IDENTITY_DUPLICATE))


def summary_sets(projection: DataFrame, how: str = "cube") -> DataFrame:
    """``severity, code, folder, grouping, n``: diagnostics counted in several groupings at once; a grouping's number has a bit, from the left, for each of severity, code and folder that is summed over.

    ``how`` is cube (all eight), rollup (severity, then code, then folder) or sets (by
    severity, by code, by folder, and all). Folder is the first part of the path, '' for
    notes in none. Every diagnostic is expanded once for each grouping and combined before
    the one shuffle.
    """
    folder = F.when(F.instr("relative_path", "/") > 0, F.substring_index("relative_path", "/", 1)).otherwise("")
    rows = report(projection).select("severity", "code", folder.alias("folder"))
    cols = ["severity", "code", "folder"]
    if how == "sets":
        grouped = rows.groupingSets([["severity"], ["code"], ["folder"], []], *cols)
    elif how in ("cube", "rollup"):
        grouped = getattr(rows, how)(*cols)
    else:
        raise ValueError(f"unknown grouping: {how}")
    return grouped.agg(F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n"))
