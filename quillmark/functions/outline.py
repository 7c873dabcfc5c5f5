"""A table function over notes: the links, headings and tasks of bodies, with their nesting.

    SELECT * FROM note_outline(TABLE(notes) PARTITION BY relative_path)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.front_matter import body

SCHEMA = "relative_path string, nth int, line int, kind string, level int, parent int, text string, target string, done boolean"
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_TASK = re.compile(r"^([ \t]*)[-*+][ \t]+\[([ xX])\](?:[ \t]+(.*))?$")
_ITEM = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+")
_LINK = re.compile(r"\[\[([^\[\]\r\n]+)\]\]")


class NoteOutline:
    """Rows of one partition are notes (relative_path, body); an element's parent is the number of the element that it stands under.

    A heading stands under the last one of a lower level, a task under the last task that is
    indented less or else under the heading, a link under the task of its line or else the
    heading. Lines between code fences hold nothing. A note without elements, a null body
    and an empty partition give no rows; repeated notes are numbered each for itself.
    """

    def eval(self, row: Row):
        headings: list[tuple[int, int]] = []
        tasks: list[tuple[int, int]] = []
        nth, fence = 0, None
        for n, line in enumerate(re.split(r"\r\n|\r|\n", row["body"] or ""), 1):
            if m := _FENCE.match(line):
                mark = m[1]
                if fence is None:
                    fence = mark
                elif mark[0] == fence[0] and len(mark) >= len(fence) and not line.strip(f" \t{mark[0]}"):
                    fence = None
                continue
            if fence is not None:
                continue
            under = headings[-1][1] if headings else None
            if m := _HEADING.match(line):
                level = len(m[1])
                headings = [h for h in headings if h[0] < level]
                under, tasks = headings[-1][1] if headings else None, []
                nth += 1
                headings.append((level, nth))
                yield row["relative_path"], nth, n, "heading", level, under, m[2] or "", None, None
                under = nth
            elif m := _TASK.match(line):
                indent = len(m[1].expandtabs(4))
                tasks = [t for t in tasks if t[0] < indent]
                under = tasks[-1][1] if tasks else under
                nth += 1
                tasks.append((indent, nth))
                yield row["relative_path"], nth, n, "task", len(tasks), under, m[3] or "", None, m[2] != " "
                under = nth
            elif line.strip() and not line.startswith((" ", "\t")) and not _ITEM.match(line):
                tasks = []  # a paragraph ends the list
            elif tasks and line.strip():
                under = tasks[-1][1]
            for m in _LINK.finditer(line):
                nth += 1
                yield row["relative_path"], nth, n, "link", None, under, m[1], re.sub(r"(?i)\.md$", "", re.sub(r"[|#].*$", "", m[1]).strip()).lower(), None


def register(spark: SparkSession, name: str = "note_outline") -> None:
    """Makes the table function known to SQL text of this session."""
    spark.udtf.register(name, F.udtf(NoteOutline, returnType=SCHEMA).asDeterministic())


def outline(notes: DataFrame) -> DataFrame:
    """The elements of every note's body, by way of the table function; notes are dealt out by path, so a note is taken whole and no partition holds more than one path's notes at a time."""
    register(notes.sparkSession)
    rows = notes.select("relative_path", body(F.coalesce("content", F.lit(""))).alias("body"))
    return notes.sparkSession.sql("SELECT * FROM note_outline(TABLE({rows}) PARTITION BY relative_path)", rows=rows)
