"""Documentation-quality scores (the formula is ours), build hashes, duplicates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import is_naive_time
from quillmark.operators.projection import Options
from quillmark.vocabulary import SENSITIVITY

_POINTS = {"uid": 25, "title": 20, "created_at": 20, "sensitivity": 20, "epistemic_state": 15}


def assess(projection: DataFrame) -> DataFrame:
    """``relative_path, score, label``: points for fields that are there and valid; 80 is good, 50 fair."""
    a = F.col("authored")
    ok = {
        "uid": a["uid"].isNotNull(),
        "title": a["title"].isNotNull(),
        "created_at": a["created_at"].isNotNull() & ~is_naive_time(a["created_at"]),
        "sensitivity": a["sensitivity"].isin(*SENSITIVITY),
        "epistemic_state": ~F.col("effective.epistemic_state_defaulted"),
    }
    score = sum((F.when(F.coalesce(ok[k], F.lit(False)), n).otherwise(0) for k, n in _POINTS.items()), F.lit(0))
    return projection.select("relative_path", score.alias("score")).withColumn("label", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 50, "fair").otherwise("poor"))


def corpus_hash(rows: DataFrame, path: str = "relative_path", content: str = "content", hashed: bool = False) -> DataFrame:
    """One row ``corpus_hash, notes``, the same in any partitioning. ``content`` may be ``hashed`` already; a null path counts as ''.

    A tree of hashes: notes meet in 65,536 buckets by a hash of their path, or of their
    content where they have none, and only the buckets' hashes meet in one task.
    """
    digest = F.col(content) if hashed else F.sha2(F.coalesce(content, F.lit("")), 256)
    one = rows.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("p"), digest.alias("h"))
    one = one.withColumn("bucket", F.substring(F.md5(F.when(F.col("p") == "", F.col("h")).otherwise(F.col("p"))), 1, 4))
    inner = one.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "h"))), "\n"), 256).alias("b"), F.count(F.lit(1)).alias("n"))
    outer = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "b"))), "\n")
    return inner.agg(F.sha2(outer, 256).alias("corpus_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("notes"))


def policy_hash(options: Options) -> str:
    return hashlib.sha256(json.dumps({"default_sensitivity": options.default}, sort_keys=True).encode()).hexdigest()


def build_block(notes: DataFrame, options: Options, version: str) -> DataFrame:
    """``engine_version, policy_hash, corpus_hash, notes, generated_at``, one row; of notes with a ``content_sha256`` the content is not read."""
    known = "content_sha256" in notes.columns
    return corpus_hash(notes, content="content_sha256" if known else "content", hashed=known).select(F.lit(version).alias("engine_version"), F.lit(policy_hash(options)).alias("policy_hash"), "corpus_hash", "notes", F.current_timestamp().alias("generated_at"))


def duplicate_content(docs: DataFrame, key: str, content: str) -> DataFrame:
    by = docs.groupBy(F.sha2(F.coalesce(content, F.lit("")), 256).alias("content_sha256"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def status(notes: DataFrame) -> DataFrame:
    """One row: how many notes there are, when they were counted, and when one was last modified (null where that is not known)."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    last = F.date_format(F.max("modified_at"), iso) if "modified_at" in notes.columns else F.lit(None).cast("string")
    out = notes.agg(F.count(F.lit(1)).alias("notes_indexed"), last.alias("last_modified_iso"))
    return out.select("notes_indexed", F.date_format(F.current_timestamp(), iso).alias("last_scan_iso"), "last_modified_iso")


def episodes(projection: DataFrame, group_id: str | None = None) -> DataFrame:
    """One episode a note, for export; the schema is ours. A null group id is left out of the JSON."""
    name = F.coalesce("authored.title", "relative_path")
    return projection.select(F.coalesce("authored.uid", "relative_path").alias("uid"), name.alias("name"), F.col("relative_path").alias("source"), F.col("effective.sensitivity").alias("sensitivity"), F.lit(group_id).cast("string").alias("group_id"))
