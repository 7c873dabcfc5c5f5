"""Job settings as data: per-field coercion, patches, gates; and lockfile pins."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import after_hash
from quillmark.vocabulary import DEFAULT_PORT, DEFAULT_SENSITIVITY, SENSITIVITY

FIELDS = ("notes_dir", "default_sensitivity", "port", "enabled", "wizard_completed")


def coerce_sensitivity(v: Column) -> Column:
    return F.when(v.isin(*SENSITIVITY), v).otherwise(DEFAULT_SENSITIVITY)


def _typed(body: Column, field: str) -> tuple[Column, Column]:
    """A field as text, and the type that the JSON has for it."""
    v = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
    return F.get_json_object(body, f"$.{field}"), F.schema_of_variant(v)


def normalize(body: Column) -> Column:
    """Valid settings from untrusted JSON: each field by itself, defaults for what is absent, ill-typed or out of range; only literal true enables."""
    folder, folder_type = _typed(body, "notes_dir")
    level, level_type = _typed(body, "default_sensitivity")
    port, port_type = _typed(body, "port")
    number = F.when(port_type.isin("BIGINT") | port_type.startswith("DECIMAL") | (port_type == "DOUBLE"), port.try_cast("double"))

    def flag(field: str) -> Column:
        v, kind = _typed(body, field)
        return F.coalesce((kind == "BOOLEAN") & (v == "true"), F.lit(False))

    return F.struct(
        F.when((folder_type == "STRING") & (folder != ""), folder).alias("notes_dir"),
        coerce_sensitivity(F.when(level_type == "STRING", level)).alias("default_sensitivity"),
        F.when((number == F.floor(number)) & number.between(1, 65535), number.cast("int")).otherwise(DEFAULT_PORT).alias("port"),
        flag("enabled").alias("enabled"),
        flag("wizard_completed").alias("wizard_completed"),
    )


def patched(base: Column, patch: Column) -> Column:
    """Settings with a patch's fields put in: absent keeps, an empty folder clears."""
    folder = F.coalesce(patch["notes_dir"], base["notes_dir"])
    rest = [F.coalesce(patch[f], base[f]).alias(f) for f in FIELDS[1:]]
    return normalize(F.to_json(F.struct(F.nullif(folder, F.lit("")).alias("notes_dir"), *rest)))


def blocked_reason(s: Column) -> Column:
    """Why serving can't be enabled; null if it can."""
    return F.when(F.coalesce(s["notes_dir"], F.lit("")) == "", "notes_dir is not set").when(~F.coalesce(s["default_sensitivity"].isin(*SENSITIVITY), F.lit(False)), "default_sensitivity is not a known level")


def connect_info(port: Column, token: Column) -> Column:
    clean = F.nullif(F.trim(token), F.lit(""))
    return F.when(clean.isNotNull(), F.struct(port.alias("port"), clean.alias("token")))


def path_of(folder: str, what: str) -> str:
    """Where a configuration folder keeps its ``settings``, ``status`` and ``token``."""
    return str(Path(folder) / {"settings": "settings.json", "status": "status.json", "token": "token"}[what])


def _text(path: str) -> str | None:
    try:
        return Path(path).read_text(encoding="utf-8")
    except (OSError, ValueError):
        return None


def _normal(spark: SparkSession, body: str | None, patch: dict | None = None) -> dict:
    row = spark.createDataFrame([(body,)], "body string").select(normalize(F.col("body")).alias("s"))
    if patch is not None:
        given = [F.lit(patch.get(f)).cast(kind).alias(f) for f, kind in zip(FIELDS, ("string", "string", "int", "boolean", "boolean"), strict=True)]
        row = row.select(patched(F.col("s"), F.struct(*given)).alias("s"))
    return row.first()["s"].asDict()


def load(spark: SparkSession, path: str) -> dict:
    """Valid settings from a file; an unreadable or unparsable one gives all defaults."""
    return _normal(spark, _text(path))


def save(path: str, settings: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(settings, indent=2), encoding="utf-8")


def update(spark: SparkSession, path: str, patch: dict) -> dict:
    """The file's settings with a patch put in, saved and returned."""
    out = _normal(spark, _text(path), patch)
    save(path, out)
    return out


def read_token(path: str) -> str | None:
    """A token file's content, trimmed; None if it is missing or blank."""
    return (_text(path) or "").strip() or None


def read_status(path: str) -> dict | None:
    """A status document; None if the file is missing. One that can't be parsed is an error."""
    body = _text(path)
    return None if body is None else json.loads(body)


def git_pins(lockfiles: DataFrame) -> DataFrame:
    """From ``content`` (lockfile JSON): git dependencies, their ref, and whether it is a full commit id."""
    entries = F.explode(F.map_entries(F.from_json(F.get_json_object("content", "$.packages"), "map<string, struct<resolved: string>>")))
    out = lockfiles.select(entries.alias("e")).select(F.col("e.key").alias("name"), F.col("e.value.resolved").alias("resolved"))
    out = out.where(F.col("resolved").startswith("git+")).withColumn("ref", after_hash(F.col("resolved")))
    return out.withColumn("pinned", F.col("ref").rlike("^[0-9a-f]{40}$"))


def pin_problems(lockfiles: DataFrame) -> DataFrame:
    """One row: the number of git dependencies and a line for each that is not pinned, in order."""
    pins = git_pins(lockfiles)
    line = F.when(~F.col("pinned"), F.concat("name", F.lit(": "), F.when(F.col("ref") == "", "no ref").otherwise(F.col("ref"))))
    return pins.agg(F.count(F.lit(1)).alias("git_dependencies"), F.array_sort(F.collect_list(line)).alias("problems"))
