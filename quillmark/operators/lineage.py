"""Lineage over resolved links: what a note goes back to, near or far.

One recursive common table expression: a level holds the distinct (note, ancestor) pairs
that as many links lead to, so its size is that of the pairs, not of the paths. A walk
ends where it comes back to the note it set out from; cycles that it only runs into are
bounded by ``max_depth``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import once
from quillmark.vocabulary import LINEAGE_CYCLE

_WALK = """
WITH RECURSIVE walk(note, ancestor, depth) MAX RECURSION LEVEL {levels} AS (
  SELECT s.note, e.target AS ancestor, 1 AS depth FROM {starts} AS s JOIN {edges} AS e ON e.source = s.note
  UNION ALL
  SELECT DISTINCT w.note, e.target, w.depth + 1 FROM walk AS w JOIN {edges} AS e ON e.source = w.ancestor WHERE w.depth < {most} AND w.ancestor <> w.note
)
SELECT note, ancestor, min(depth) AS depth FROM walk GROUP BY note, ancestor LIMIT ALL
"""


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``source, target`` of resolved links; dangling ones lead nowhere."""
    return resolved.where("target_path IS NOT NULL").select(F.col("source_path").alias("source"), F.col("target_path").alias("target")).distinct()


def ancestors(resolved: DataFrame, of: DataFrame | None = None, max_depth: int = 64) -> DataFrame:
    """``note, ancestor, depth``: every note that links lead to from a note, with the fewest links that do; a note in a cycle is an ancestor of itself.

    ``of`` (relative_path) limits the notes set out from, not the links followed; without
    it the result holds all connected pairs. Ancestors farther than ``max_depth`` links are left out.
    """
    linked = once(edges(resolved))  # read again at every level
    starts = (linked.select(F.col("source").alias("note")) if of is None else of.select(F.col("relative_path").alias("note"))).distinct()
    return resolved.sparkSession.sql(_WALK, levels=max_depth + 1, most=max_depth, starts=starts, edges=linked)


def lineage(notes: DataFrame, resolved: DataFrame, max_depth: int = 64) -> DataFrame:
    """``relative_path, ancestors, depth, roots, cyclic``, a row a note: how many other notes it goes back to, how far, how many of them link no further, and whether it comes back to itself."""
    found = ancestors(resolved, max_depth=max_depth)
    inner = found.select(F.col("note").alias("ancestor"), F.lit(True).alias("links")).distinct()
    found = found.join(inner, "ancestor", "left")
    other = F.col("ancestor") != F.col("note")
    per = found.groupBy("note").agg(
        F.count(F.when(other, 1)).alias("ancestors"),
        F.max(F.when(other, F.col("depth"))).alias("depth"),
        F.count(F.when(other & F.col("links").isNull(), 1)).alias("roots"),
        F.max(~other).alias("cyclic"),
    )
    out = notes.select("relative_path").join(per, F.col("relative_path") == F.col("note"), "left")
    zero = F.lit(0).cast("long")
    return out.select("relative_path", F.coalesce("ancestors", zero).alias("ancestors"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("roots", zero).alias("roots"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def diagnostics(traced: DataFrame) -> DataFrame:
    """``code, severity, subject, message`` of notes that come back to themselves."""
    return traced.where("cyclic").select(F.lit(LINEAGE_CYCLE).alias("code"), F.lit("warning").alias("severity"), F.col("relative_path").alias("subject"), F.lit("links lead back to the note").alias("message"))
