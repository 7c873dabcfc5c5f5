"""Suggestions made elsewhere: requests, and responses checked without ever changing a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import resolve_task
from quillmark.vocabulary import TASKS

CONTRACT = "1.0"  # of requests and responses; a deployment may pass its own
#: Patch keys by which a suggestion would claim authority; ours but for the first.
UNSAFE = ("approved", "authoritative", "effective_sensitivity")
_PROPOSAL = "struct<contractVersion: string, proposalId: string, proposalType: string, targetId: string, rationale: string, confidence: double, evidenceRefs: array<string>, generator: struct<system: string, programVersion: string>, proposedPatch: string>"
_RESPONSE = f"contractVersion string, requestId string, proposals array<{_PROPOSAL}>"


def requests(notes: DataFrame, task: str, sensitivity: str | None = None, contract: str = CONTRACT) -> DataFrame:
    """A request for each note; the id is random, so keep it out of anything that must repeat."""
    out = notes.select(F.lit(contract).alias("contractVersion"), F.concat(F.lit("request:"), F.uuid()).alias("requestId"), resolve_task(F.lit(task)).alias("task"), F.col("relative_path").alias("targetId"), F.col("content").alias("noteText"), F.lit(sensitivity).cast("string").alias("effectiveSensitivity"))
    return out.where(F.col("task").isin(*TASKS.values()))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, body`` from JSON lines, one response a line; the id is the one that a response echoes."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.get_json_object("value", "$.requestId").alias("request_id"), F.col("value").alias("body"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, task, target_id`` of saved requests, JSON lines as ``requests`` makes them."""
    fields = [F.get_json_object("value", f"$.{f}").alias(n) for f, n in (("requestId", "request_id"), ("task", "task"), ("targetId", "target_id"))]
    return spark.read.text(path).where(F.trim("value") != "").select(*fields).where("request_id IS NOT NULL").distinct()


def check(responses: DataFrame, asked: DataFrame, contract: str = CONTRACT) -> DataFrame:
    """``responses`` (request_id, body JSON) against ``asked`` (request_id, task, target_id): one row a proposal, itself and its problem, null if accepted."""
    r = responses.withColumn("r", F.from_json("body", _RESPONSE)).join(asked, "request_id", "left")
    flat = r.select("request_id", "task", "target_id", F.col("r.requestId").alias("echo"), F.col("r.contractVersion").alias("version"), F.explode_outer("r.proposals").alias("p"), F.col("r").isNull().alias("broken"))
    unsafe = F.lit(False)
    for k in UNSAFE:
        unsafe = unsafe | F.get_json_object("p.proposedPatch", f"$.{k}").isNotNull()
    problem = (
        F.when(F.col("broken") | F.col("version").isNull(), "malformed response")
        .when(F.col("task").isNull(), "unknown request")
        .when(F.col("version") != contract, "contract version differs")
        .when(F.col("echo").isNull() | (F.col("echo") != F.col("request_id")), "answers another request")
        .when(F.col("p").isNull(), None)
        .when(F.coalesce(F.col("p.proposalType") != F.col("task"), F.lit(True)), "proposal type differs from the task")
        .when(F.coalesce(F.col("p.targetId") != F.col("target_id"), F.lit(True)), "proposal is for another note")
        .when(F.col("p.confidence").isNull() | ~F.col("p.confidence").between(0, 1), "confidence is not in 0..1")
        .when(unsafe, "patch claims authority")
    )
    return flat.select("request_id", F.col("p.proposalId").alias("proposal_id"), problem.alias("problem"), F.col("p").alias("proposal"))


def _joined_problems() -> Column:
    lines = F.array_sort(F.collect_set(F.when(F.col("problem").isNotNull(), F.concat(F.lit("PROPOSAL: "), "problem"))))
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def outcome(checked: DataFrame) -> DataFrame:
    """A row a request: error if something is wrong and nothing is left, else ok, with warnings joined."""
    good = F.count(F.when(F.col("problem").isNull() & F.col("proposal_id").isNotNull(), 1))
    out = checked.groupBy("request_id").agg(good.alias("proposals"), _joined_problems().alias("warnings"))
    return out.withColumn("status", F.when(F.col("warnings").isNotNull() & (F.col("proposals") == 0), "error").otherwise("ok")).withColumn("authoritative", F.lit(False))


def document(checked: DataFrame, contract: str = CONTRACT) -> DataFrame:
    """``request_id, json``: the accepted proposals of each request as they are handed on, never authoritative; warnings only where there are some."""
    good = F.when(F.col("problem").isNull() & F.col("proposal_id").isNotNull(), F.col("proposal"))
    out = checked.groupBy("request_id").agg(F.array_sort(F.collect_list(good), lambda x, y: F.when(x["proposalId"] < y["proposalId"], -1).when(x["proposalId"] > y["proposalId"], 1).otherwise(0)).alias("proposals"), _joined_problems().alias("warnings"))
    return out.select("request_id", F.to_json(F.struct(F.lit(contract).alias("contractVersion"), F.lit(False).alias("authoritative"), "proposals", "warnings")).alias("json"))
