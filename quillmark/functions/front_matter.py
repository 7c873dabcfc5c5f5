"""Splitting notes and decoding their front matter.

Both decoders add one struct of raw strings, so what follows does not care which ran:
``decode_flat`` reads scalar lines inside the JVM, ``decode_yaml`` whole YAML in an
Arrow-batched function. Each step is a column that later ones refer to several times, so
the optimizer keeps it a step and no expression is evaluated twice.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n|\z)"
SCALARS = ("okf_version", "uid", "title", "type", "created_at", "updated_at", "sensitivity", "epistemic_state", "confidence", "authorship_origin", "author_id", "source_type")
LISTS = ("tags", "handling")
FIELDS = ", ".join([f"{k} string" for k in SCALARS] + [f"{k} array<string>" for k in LISTS])
#: Where else a field may stand, after its own name: short forms, and paths in nested maps.
_SHORT = {"created_at": "created", "updated_at": "updated"}
_NESTED = {
    "sensitivity": ("sensitivity", "level"), "epistemic_state": ("epistemic", "state"), "confidence": ("epistemic", "confidence"), "authorship_origin": ("authorship", "origin"),
    "author_id": ("authorship", "author_id"), "source_type": ("provenance", "source_type"),
}
_LINE = rf"""(?m)^(?:{"|".join((*SCALARS, *_SHORT.values(), "tags"))}):[ \t]*(?:"[^"\r\n]*"|'[^'\r\n]*'|\[[^\]\r\n]*\]|[^"'\s\[{{][^\r\n]*?)[ \t]*\r?$"""


def body(content: Column) -> Column:
    return F.regexp_replace(content, _BLOCK, "")


def split(notes: DataFrame, content: str, block: str, front: str) -> DataFrame:
    """Adds ``block``, the front matter with its fences ('' if there is none), and ``front``, without them (null if there is none). The content is searched once."""
    notes = notes.withColumn(block, F.regexp_extract(F.coalesce(content, F.lit("")), _BLOCK, 0))
    return notes.withColumn(front, F.when(F.col(block) != "", F.regexp_extract(block, _BLOCK, 1)))


def decode_flat(notes: DataFrame, front: str, out: str, scratch: str) -> DataFrame:
    """Adds the struct ``out`` from the first line of each key. All lines are found in one pass; fields are looked up in what it finds. ``scratch`` is a column to be dropped."""
    blank = F.lit(" \t\r")

    def entry(line: Column) -> Column:
        value = F.btrim(F.substring(line, F.instr(line, F.lit(":")) + 1, F.length(line)), blank)
        quoted = F.substring(value, 1, 1).isin('"', "'")
        return F.struct(F.substring_index(line, ":", 1).alias("key"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    notes = notes.withColumn(scratch, F.transform(F.regexp_extract_all(F.coalesce(front, F.lit("")), F.lit(_LINE), F.lit(0)), entry))

    def first(key: str) -> Column:
        return F.try_element_at(F.filter(scratch, lambda e: e["key"] == key), F.lit(1))["value"]

    def scalar(key: str) -> Column:
        value = F.nullif(first(key), F.lit(""))
        return F.when(~value.startswith("["), value)

    listed = F.transform(F.split(F.btrim(first("tags"), F.lit("[]")), ","), lambda x: F.trim(F.translate(x, "\"'", "")))
    listed = F.coalesce(F.filter(listed, lambda x: x != ""), F.array().cast("array<string>"))
    cols = [F.coalesce(scalar(k), scalar(_SHORT[k])) if k in _SHORT else scalar(k) for k in SCALARS]
    return notes.withColumn(out, F.struct(*(c.alias(k) for c, k in zip(cols, SCALARS, strict=True)), listed.alias("tags"), F.lit(None).cast("array<string>").alias("handling")))


@cache
def _loader():
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    # timestamps stay the text that was written; their zone is judged later
    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return yaml.load, Loader, (yaml.YAMLError, ValueError, RecursionError)


def fields(block: str) -> dict | None:
    """The raw fields of a YAML block; None where it is no map."""
    load, loader, errors = _loader()
    try:
        doc = load(block, loader)  # noqa: S506  a safe loader
    except errors:
        return None
    if doc is None:
        doc = {}
    if not isinstance(doc, dict):
        return None

    def value(key: str):
        found = doc
        for k in _NESTED.get(key, (key,)):
            found = found.get(k) if isinstance(found, dict) else None
        return doc.get(key, doc.get(_SHORT.get(key))) if found is None else found

    def text(found):
        if found is None or isinstance(found, dict | list):
            return None
        return ("true" if found else "false") if isinstance(found, bool) else str(found)

    def items(found):
        return [text(x) for x in found if text(x) is not None] if isinstance(found, list) else []

    label = doc.get("sensitivity")
    return {k: text(value(k)) or None for k in SCALARS} | {"tags": items(doc.get("tags")), "handling": items(label.get("handling")) if isinstance(label, dict) else []}


def decode_yaml(notes: DataFrame, front: str, out: str) -> DataFrame:
    """Adds the struct ``out``; null where the block is no YAML map."""
    kind = pa.struct([(k, pa.string()) for k in SCALARS] + [(k, pa.list_(pa.string())) for k in LISTS])

    @F.arrow_udf(f"struct<{FIELDS.replace(' string', ': string').replace(' array', ': array')}>")
    def decode(blocks: pa.Array) -> pa.Array:
        return pa.array([fields(b or "") for b in blocks.to_pylist()], kind)

    return notes.withColumn(out, decode(F.col(front)))
