"""Note sources: folders, rows in memory, and the derived view over ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.vocabulary import SENSITIVITY


def _bare(uri: Column) -> Column:
    """The path of a file's URI: without scheme and host, decoded."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """``relative_path, content, modified_at`` of every Markdown file under a folder.

    The folder is made absolute by its own file system, and paths are cut after exactly
    that prefix; a file that Spark names by another root keeps its whole path.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    whole = _bare(F.col("_metadata.file_path"))
    relative = F.when(whole.startswith(root), F.substring(whole, len(root) + 1, 1 << 30)).otherwise(whole)
    return files.select(relative.alias("relative_path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))


def notes_from_rows(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(files, "relative_path string, content string")


def note(notes: DataFrame, path: str) -> DataFrame:
    return notes.where(F.col("relative_path") == path)


def read_one(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("relative_path"), F.col("value").alias("content"))


def notes_from_documents(docs: DataFrame) -> DataFrame:
    """Notes composed from rows of ``documents``: labels, states and times follow the doc_id; the text is the body, then one link."""
    i = F.col("doc_id")
    labels = [*(f'sensitivity: "{x}"\n' for x in SENSITIVITY), "", 'sensitivity: "unclassified"\n']
    states = ['epistemic_state: "fact"\n', 'epistemic_state: "hypothesis"\n', 'epistemic_state: "gospel"\n', ""]
    times = ['created_at: "2026-01-01T00:00:00Z"\n', "created_at: 2026-01-01 00:00:00\n", ""]

    def pick(lines: list[str]):
        return F.element_at(F.array(*map(F.lit, lines)), (i % len(lines) + 1).cast("int"))

    title = F.when(i % 4 != 0, F.concat(F.lit('title: "Note '), i.cast("string"), F.lit('"\n'))).otherwise("")
    head = F.concat(F.lit('---\nuid: "'), (i - F.when(i % 50 == 49, 1).otherwise(0)).cast("string"), F.lit('"\n'), pick(labels), title, pick(states), pick(times), F.lit("---\n"))
    link = F.concat(F.lit("\n[[doc-"), ((i * 7) % 1200).cast("string"), F.lit("]]"))
    return docs.select(F.concat(F.lit("doc-"), i.cast("string"), F.lit(".md")).alias("relative_path"), F.concat(head, F.coalesce("text", F.lit("")), link).alias("content"))


#: Front matter as people write it: quoted, plain, in flow style, with foreign line ends, broken, missing, not closed, without a label.
FORMS = (
    '---\nokf_version: "2.3"\nuid: "{id}"\ncreated_at: "2026-03-{day}T08:00:00Z"\nepistemic:\n  state: "{state}"\n  confidence: 0.5\nsensitivity:\n  level: "{level}"\n  handling:\n    - "keep"\n---\n',
    "---\r\nuid: '{id}'\r\ncreated: 2026-03-{day} 08:00\r\nepistemic:\r\n  state: '{state}'\r\nsensitivity:\r\n  level: '{level}'\r\n---\r\n",
    "---\nuid: {id}\nepistemic: {{state: {state}, confidence: 0.25}}\nsensitivity: {{level: {level}, handling: [keep, local]}}\ntags: [a, b]\n---\n",
    "---\n# kept by hand\nuid: {id}\nupdated_at: 2026-03-{day}T08:00:00\nepistemic_state: {state}\nsensitivity: {level}\n---\n",
    '---\nuid: "{id}"\nsensitivity: [{level}\n---\n',
    "",
    '---\nuid: "{id}"\nsensitivity: "{level}"\n',
    '---\nuid: "{id}"\nepistemic:\n  state: "{state}"\nprovenance:\n  level: "{level}"\n---\n',
)


def varied_notes_from_documents(docs: DataFrame) -> DataFrame:
    """Notes composed from rows of ``documents`` in eight forms of front matter, by doc_id; the text is the body."""
    i = F.col("doc_id")

    def pick(values, by):
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

    out = pick([x.replace("{{", "{").replace("}}", "}") for x in FORMS], i)
    parts = {"id": i.cast("string"), "level": pick([*SENSITIVITY, "unclassified"], F.floor(i / 8)), "state": pick(["fact", "hypothesis", "gospel"], F.floor(i / 4)), "day": F.lpad((i % 28 + 1).cast("string"), 2, "0")}
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return docs.select(F.concat(F.lit("varied/"), i.cast("string"), F.lit(".md")).alias("relative_path"), F.concat(out, F.coalesce("text", F.lit(""))).alias("content"))
