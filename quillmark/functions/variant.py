"""Front matter as one VARIANT column: every field that was written stays queryable, known or not."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.front_matter import _loader, split

#: Values that one block may expand to; anchors can repeat a value without end.
MOST_VALUES = 100_000


def _plain(value: object, left: list[int]) -> object:
    """A YAML value as JSON has it: keys as text, times as written, bytes in base64, sets as lists; no number that JSON lacks."""
    left[0] -= 1
    if left[0] < 0:
        raise ValueError("too many values")
    if isinstance(value, dict):
        return {_key(k): _plain(v, left) for k, v in value.items()}
    if isinstance(value, set):
        value = sorted(value, key=str)
    if isinstance(value, list | tuple):
        return [_plain(v, left) for v in value]
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def _key(key: object) -> str:
    return key if isinstance(key, str) else json.dumps(key) if key is None or isinstance(key, bool | int | float) else str(key)


def block_json(block: str | None) -> str | None:
    """A YAML block as JSON; null if it is no map, '{}' if it is empty."""
    load, loader, errors = _loader()
    try:
        doc = load(block or "", loader)  # noqa: S506  a safe loader
        if doc is None:
            return "{}"
        return json.dumps(_plain(doc, [MOST_VALUES]), ensure_ascii=False) if isinstance(doc, dict) else None
    except (*errors, TypeError):
        return None


def decode_variant(notes: DataFrame, out: str = "front_matter") -> DataFrame:
    """``notes`` (relative_path, content, ...) with the VARIANT ``out``: the whole front matter, null where there is none or it is no YAML map.

    Key order and the kinds of scalars are kept as JSON keeps them; numbers too large for
    a decimal become doubles. Earlier columns named ``out`` are replaced. Narrow: no shuffle.
    """

    @F.arrow_udf("string")
    def convert(blocks: pa.Array) -> pa.Array:
        return pa.array([None if b is None else block_json(b) for b in blocks.to_pylist()], pa.string())

    keep = [c for c in notes.columns if c != out]
    read = split(notes.select(keep), "content", "__block", "__front")
    return read.select(*keep, F.try_parse_json(convert(F.when(F.col("__block") != "", F.coalesce("__front", F.lit(""))))).alias(out))


def field(front_matter: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.epistemic.confidence`` or ``$.tags[0]``; null where it is absent or of another kind."""
    return F.try_variant_get(front_matter, path, kind)


def with_fields(notes: DataFrame, fields: Mapping[str, tuple[str, str]], front_matter: str = "front_matter") -> DataFrame:
    """Adds a column for each name -> (path, kind)."""
    return notes.withColumns({name: field(F.col(front_matter), path, kind) for name, (path, kind) in fields.items()})


def paths(notes: DataFrame, key: str = "relative_path", front_matter: str = "front_matter") -> DataFrame:
    """``key, path, kind``: the fields of the first two levels of maps, with the kind of each value (OBJECT, ARRAY, STRING, BIGINT, DECIMAL, ...).

    One pass: both levels come from the same rows, and no filter on the front matter can be
    pushed below the function that decodes it, which would decode every note again.
    """
    tvf = notes.sparkSession.tvf

    def kind(value: str) -> Column:
        return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)

    top = notes.select(F.col(key), F.col(front_matter).alias("__f"))
    top = top.select(key, F.when(F.schema_of_variant("__f").startswith("OBJECT"), F.col("__f")).alias("__f"))
    one = top.lateralJoin(tvf.variant_explode(F.col("__f").outer())).select(key, F.concat(F.lit("$."), "key").alias("__p"), F.col("value").alias("__v"))
    # each field as itself and, if it is a map, as what is in it
    each = one.select(key, "__p", "__v", F.explode(F.array(F.lit(1), F.lit(2))).alias("__level")).where((F.col("__level") == 1) | (kind("__v") == "OBJECT"))
    each = each.withColumn("__in", F.when(F.col("__level") == 2, F.col("__v")))
    both = each.lateralJoin(tvf.variant_explode_outer(F.col("__in").outer())).where("__level = 1 OR pos IS NOT NULL")
    first = F.col("__level") == 1
    both = both.select(F.col(key), F.when(first, F.col("__p")).otherwise(F.concat("__p", F.lit("."), "key")).alias("path"), F.when(first, F.col("__v")).otherwise(F.col("value")).alias("__w"))
    return both.select(key, "path", kind("__w").alias("kind"))


def write_shredded(notes: DataFrame, path: str) -> None:
    """Parquet whose variant columns are shredded: fields that rows share become columns of their own in the file, the rest stays binary, and readers of few paths read few columns."""
    spark = notes.sparkSession
    wanted = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        notes.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_shredded(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_shredded`` wrote; paths asked of a variant are pushed into the scan."""
    return spark.read.parquet(path)
