"""The projection: notes onto a typed schema with fail-closed defaults and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import front_matter as fm
from quillmark.functions.text import is_naive_time, rank
from quillmark.vocabulary import (
    DEFAULT_SENSITIVITY,
    EPISTEMIC_FALLBACK,
    EPISTEMIC_INVALID,
    EPISTEMIC_MISSING,
    EPISTEMIC_STATES,
    FRONT_MATTER_INVALID,
    SENSITIVITY,
    SENSITIVITY_INVALID,
    SENSITIVITY_MISSING,
    TEMPORAL_NAIVE,
)

DIAGNOSTIC = "struct<code: string, severity: string, field: string, message: string>"


@dataclass(frozen=True)
class Options:
    """``default_sensitivity`` stands in for a missing label only; an unknown level is ignored. ``flat`` reads scalar front matter without Python."""

    default_sensitivity: str | None = None
    flat: bool = False

    @property
    def default(self) -> str:
        return self.default_sensitivity if self.default_sensitivity in SENSITIVITY else DEFAULT_SENSITIVITY


def diagnostic(when: Column, code: str, severity: str, field: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    item = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), message.alias("message"))
    return F.when(when, item).otherwise(F.lit(None).cast(DIAGNOSTIC))


def project(notes: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008  frozen
    """``notes`` (relative_path, content, ...) with has_front_matter, front_matter_valid, authored, effective and diagnostics.

    A null content counts as empty. Earlier columns of the added names are replaced.
    Narrow; with flat options it stays inside the JVM, and the body is not touched unless
    a later operator reads it.
    """
    keep = [c for c in notes.columns if c not in ("has_front_matter", "authored", "front_matter_valid", "effective", "diagnostics")]
    a = F.col("authored")
    out = fm.split(notes.select(keep), "content", "__block", "__front").withColumn("has_front_matter", F.col("__block") != "")
    out = fm.decode_flat(out, "__front", "authored", "__lines") if options.flat else fm.decode_yaml(out, "__front", "authored")
    out = out.withColumn("front_matter_valid", F.col("has_front_matter") & a.isNotNull())
    level, state = a["sensitivity"], a["epistemic_state"]
    known = F.coalesce(level.isin(*SENSITIVITY), F.lit(False))
    effective = F.when(level.isNull(), options.default).when(known, level).otherwise(DEFAULT_SENSITIVITY)
    sure = F.coalesce(state.isin(*EPISTEMIC_STATES), F.lit(False))
    out = out.withColumn(
        "effective",
        F.struct(effective.alias("sensitivity"), rank(effective).alias("sensitivity_rank"), F.when(sure, state).otherwise(EPISTEMIC_FALLBACK).alias("epistemic_state"), (~sure).alias("epistemic_state_defaulted")),
    )
    found = [
        diagnostic(F.col("has_front_matter") & a.isNull(), FRONT_MATTER_INVALID, "error", "front_matter", "front matter is not a YAML map"),
        diagnostic(level.isNull(), SENSITIVITY_MISSING, "warning", "sensitivity", "sensitivity is missing; the default applies"),
        diagnostic(level.isNotNull() & ~known, SENSITIVITY_INVALID, "error", "sensitivity", F.concat(F.lit("unknown sensitivity: "), level)),
        diagnostic(state.isNull(), EPISTEMIC_MISSING, "info", "epistemic_state", "epistemic state is missing"),
        diagnostic(state.isNotNull() & ~sure, EPISTEMIC_INVALID, "error", "epistemic_state", F.concat(F.lit("unknown epistemic state: "), state)),
        *[diagnostic(is_naive_time(a[f]), TEMPORAL_NAIVE, "warning", f, F.concat(F.lit("no time zone: "), a[f])) for f in ("created_at", "updated_at")],
    ]
    out = out.withColumn("diagnostics", F.array_compact(F.array(*found)))
    made = F.struct("has_front_matter", "authored", "front_matter_valid", "effective", "diagnostics")
    # a generator of one row: filters on what is made here stay above it, so that the optimizer does not copy the expressions into them
    return out.select(*keep, F.inline_outer(F.array(made)))


def reason(projection: DataFrame) -> Column:
    """How the effective sensitivity came about: ok, missing or invalid."""
    codes = projection["diagnostics"]["code"]
    return F.when(F.array_contains(codes, SENSITIVITY_MISSING), "missing").when(F.array_contains(codes, SENSITIVITY_INVALID), "invalid").otherwise("ok")


def visible(projection: DataFrame, ceiling: str) -> DataFrame:
    """The notes that a reader with this ceiling may see; an unknown ceiling sees only the most open level."""
    top = SENSITIVITY.index(ceiling) + 1 if ceiling in SENSITIVITY else 1
    return projection.where(F.col("effective.sensitivity_rank") <= top)
