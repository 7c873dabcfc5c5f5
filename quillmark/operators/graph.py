"""The link graph of a note folder. Link syntax beyond ``[[target]]`` and the resolution rule are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.front_matter import body
from quillmark.operators.validate import duplicate_identities
from quillmark.sources.shared import once
from quillmark.vocabulary import LINK_DANGLING

_LINK = r"\[\[([^\[\]\r\n]+)\]\]"


def linked(notes: DataFrame) -> DataFrame:
    """``notes`` with ``links``, the targets as written in the body; what uses links reads this column where it is there, not the content."""
    return notes.withColumn("links", F.regexp_extract_all(body(F.coalesce("content", F.lit(""))), F.lit(_LINK), F.lit(1)))


def links(notes: DataFrame) -> DataFrame:
    """``source_path, target_raw, target``: one row a link; ``target`` without alias, heading and extension, in lower case."""
    notes = notes if "links" in notes.columns else linked(notes)
    out = notes.select(F.col("relative_path").alias("source_path"), F.explode("links").alias("target_raw"))
    bare = F.trim(F.regexp_replace("target_raw", r"[|#].*$", ""))
    return out.withColumn("target", F.lower(F.regexp_replace(bare, r"(?i)\.md$", "")))


def stems(notes: DataFrame) -> DataFrame:
    """Each name that a link may use, with its note; of notes with one name the first by path."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split("relative_path", "/"), -1), r"(?i)\.md$", ""))
    return notes.groupBy(stem.alias("target")).agg(F.min("relative_path").alias("target_path"))


def resolve(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds ``target_path``; null is a dangling link. The join's side is chosen by Spark from sizes."""
    return found.join(stems(notes), "target", "left").select("source_path", "target_raw", "target_path", F.lit("link").alias("link_type"))


def dangling(found: DataFrame, notes: DataFrame) -> DataFrame:
    return found.join(stems(notes), "target", "left_anti").select("source_path", "target_raw")


def stats(notes: DataFrame) -> DataFrame:
    """One row: notes, links, resolved links, distinct targets; notes and links are counted together."""
    none = F.lit(None).cast("string")
    both = notes.select(F.lit(1).alias("note"), none.alias("target_raw"), none.alias("target_path"))
    both = both.unionByName(resolve(links(notes), notes).select(F.lit(0).alias("note"), "target_raw", "target_path"))
    return both.agg(F.coalesce(F.sum("note"), F.lit(0)).alias("notes"), F.count("target_raw").alias("links"), F.count("target_path").alias("resolved"), F.countDistinct("target_raw").alias("targets"))


def diagnostics(projection: DataFrame) -> DataFrame:
    """``code, severity, subject, message`` of dangling links and of identities that several notes bear."""
    loose = dangling(links(projection), projection).distinct()
    loose = loose.select(F.lit(LINK_DANGLING).alias("code"), F.lit("warning").alias("severity"), F.col("source_path").alias("subject"), F.concat(F.lit("link to no note: "), "target_raw").alias("message"))
    same = duplicate_identities(projection)
    return loose.unionByName(same.select("code", F.lit("error").alias("severity"), F.col("first_path").alias("subject"), F.concat(F.lit("several notes have the uid "), "uid").alias("message")))


def graph_json(projection: DataFrame) -> DataFrame:
    """``kind, key, json``: nodes, links, statistics and diagnostics; their order by (kind, key) is the stable serialisation. Contents are searched once."""
    projection = projection if "links" in projection.columns else once(linked(projection).select("relative_path", "authored", "effective", "links"))
    a, e = F.col("authored"), F.col("effective")
    node = F.struct(a["epistemic_state"].alias("authoredEpistemicState"), e["epistemic_state"].alias("epistemicState"), F.col("relative_path").alias("id"), e["sensitivity"].alias("sensitivity"), a["tags"].alias("tags"), a["title"].alias("title"), a["type"].alias("type"), a["uid"].alias("uid"))
    nodes = projection.select(F.lit("node").alias("kind"), F.col("relative_path").alias("key"), F.to_json(node).alias("json"))
    edges = resolve(links(projection), projection)
    edges = edges.select(F.lit("link").alias("kind"), F.concat_ws("\u0000", "source_path", "target_raw").alias("key"), F.to_json(F.struct("link_type", "source_path", "target_path", "target_raw")).alias("json"))
    counts = stats(projection).select(F.lit("stats").alias("kind"), F.lit("").alias("key"), F.to_json(F.struct("links", "notes", "resolved", "targets")).alias("json"))
    found = diagnostics(projection)
    found = found.select(F.lit("diagnostic").alias("kind"), F.concat_ws("\u0000", "code", "subject", "message").alias("key"), F.to_json(F.struct("code", "message", "severity", "subject")).alias("json"))
    return nodes.unionByName(edges).unionByName(counts).unionByName(found)


def page_links(pages: DataFrame) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", href.alias("href"))
