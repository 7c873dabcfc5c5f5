"""The SQL surface: one view a ceiling, so that no caller can forget the filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.projection import visible
from quillmark.vocabulary import SENSITIVITY

COLUMNS = ("relative_path", "uid", "title", "type", "tags", "created_at", "updated_at", "sensitivity", "sensitivity_rank", "epistemic_state")


def flat(projection: DataFrame) -> DataFrame:
    """A projection as the flat rows that views show; contents are not among them."""
    a, e = F.col("authored"), F.col("effective")
    return projection.select("relative_path", a["uid"].alias("uid"), a["title"].alias("title"), a["type"].alias("type"), a["tags"].alias("tags"), a["created_at"].alias("created_at"), a["updated_at"].alias("updated_at"), e["sensitivity"].alias("sensitivity"), e["sensitivity_rank"].alias("sensitivity_rank"), e["epistemic_state"].alias("epistemic_state"))


def store(projection: DataFrame, path: str) -> None:
    """Writes the flat rows sorted by rank within files, so that a view's filter skips row groups that its reader may not see."""
    flat(projection).sortWithinPartitions("sensitivity_rank", "relative_path").write.mode("overwrite").parquet(path)


def register(spark: SparkSession, rows: DataFrame, prefix: str = "notes_for_") -> dict[str, str]:
    """Registers ``notes_for_public`` to ``notes_for_secret`` over flat rows; returns the view of each ceiling. The rows themselves get no name."""
    names = {}
    for ceiling in SENSITIVITY:
        names[ceiling] = f"{prefix}{ceiling}"
        top = SENSITIVITY.index(ceiling) + 1
        rows.where(F.col("sensitivity_rank") <= top).select(*COLUMNS).createOrReplaceTempView(names[ceiling])
    return names


def ask(spark: SparkSession, ceiling: str, query: str, views: dict[str, str] | None = None, **args: object) -> DataFrame:
    """A query over ``{notes}``, which is what the ceiling may see; values go in as ``:name`` parameters, never as text. An unknown ceiling sees the most open level only."""
    names = views or {c: f"notes_for_{c}" for c in SENSITIVITY}
    return spark.sql(query, args=args or None, notes=spark.table(names[ceiling if ceiling in SENSITIVITY else SENSITIVITY[0]]))


def seen_by(projection: DataFrame, ceiling: str) -> DataFrame:
    """The flat rows of one ceiling, without a view."""
    return flat(visible(projection, ceiling))
