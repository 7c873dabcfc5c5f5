"""Lineage, whole front matter, change feed, keyed state, windows, live proposals, joins by time, groupings, outlines, views, sketches."""

import itertools
import json
import os
import random
import threading
import time
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quillmark.functions import outline as outlines
from quillmark.functions import variant
from quillmark.operators import graph, joins, lineage, sketches, validate, views
from quillmark.operators.projection import Options, project
from quillmark.plans import commands
from quillmark.sources import changes, live
from quillmark.sources.notes import notes_from_rows, read_notes
from quillmark.streaming import state, windows

UTC = timezone.utc


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sources


@pytest.mark.parametrize("where", ["data/a", "data/a/", "./data/a", "{abs}/data/a", "file://{abs}/data/a"])
def test_paths_are_cut_at_the_folder(spark, tmp_path, monkeypatch, where):
    """Folder ``a`` below ``data``, which ends in a: only the folder itself is cut off."""
    (tmp_path / "data" / "a" / "sub").mkdir(parents=True)
    (tmp_path / "data" / "a" / "sub" / "n + ä%41.md").write_text("x")
    (tmp_path / "data" / "a" / "a").mkdir()
    (tmp_path / "data" / "a" / "a" / "a.md").write_text("y")
    old = spark.sparkContext._jsc.hadoopConfiguration()
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(old)
    before = home.getWorkingDirectory()
    home.setWorkingDirectory(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(tmp_path)))
    try:
        folder = where.format(abs=tmp_path) if "{" in where else str(tmp_path / where)
        assert rows(read_notes(spark, folder).select("relative_path")) == [("a/a.md",), ("sub/n + ä%41.md",)]
    finally:
        home.setWorkingDirectory(before)


# --- lineage

LINKED = [("a.md", "[[b]] [[c]]"), ("b.md", "[[d]]"), ("c.md", "[[d]] [[gone]]"), ("d.md", ""), ("x.md", "[[y]]"), ("y.md", "[[x]]"), ("z.md", "[[x]]"), ("s.md", "[[s]]")]


def traced(spark, files, **kw):
    notes = notes_from_rows(spark, files)
    return notes, graph.resolve(graph.links(notes), notes)


def test_lineage_and_cycles(spark):
    notes, resolved = traced(spark, LINKED)
    assert rows(lineage.lineage(notes, resolved)) == [("a.md", 3, 2, 1, False), ("b.md", 1, 1, 1, False), ("c.md", 1, 1, 1, False), ("d.md", 0, 0, 0, False), ("s.md", 0, 0, 0, True), ("x.md", 1, 1, 0, True), ("y.md", 1, 1, 0, True), ("z.md", 2, 2, 0, False)]
    assert [r["subject"] for r in lineage.diagnostics(lineage.lineage(notes, resolved)).orderBy("subject").collect()] == ["s.md", "x.md", "y.md"]
    assert rows(lineage.ancestors(resolved, notes.where("relative_path = 'z.md'"))) == [("z.md", "x.md", 1), ("z.md", "y.md", 2)]
    assert rows(lineage.ancestors(resolved, max_depth=1)) == sorted((a, b, 1) for a, b in [("a.md", "b.md"), ("a.md", "c.md"), ("b.md", "d.md"), ("c.md", "d.md"), ("s.md", "s.md"), ("x.md", "y.md"), ("y.md", "x.md"), ("z.md", "x.md")])


def test_lineage_of_random_graphs(spark):
    """Distinct pairs a level, not paths: a graph with very many ways from end to end is walked."""
    rng = random.Random(1)
    names = [f"n{i}" for i in range(14)]
    links = {n: rng.sample(names, rng.randrange(4)) for n in names}
    layers = [f"l{i}{c}" for i in range(20) for c in "ab"]
    links |= {f"l{i}{c}": [f"l{i + 1}a", f"l{i + 1}b"] if i < 19 else [] for i in range(20) for c in "ab"}  # 2^19 ways
    _, resolved = traced(spark, [(f"{n}.md", " ".join(f"[[{t}]]" for t in links[n])) for n in names + layers])
    want = set()
    for n in links:
        depth, front = {}, set(links[n])
        for d in itertools.count(1):
            front -= set(depth)
            if not front:
                break
            depth |= dict.fromkeys(front, d)
            front = {t for f in front for t in links[f]}
        want |= {(f"{n}.md", f"{t}.md", d) for t, d in depth.items()}
    assert set(rows(lineage.ancestors(resolved))) == want


def test_lineage_of_nothing(spark):
    notes, resolved = traced(spark, [("a.md", "")])
    assert rows(lineage.lineage(notes, resolved)) == [("a.md", 0, 0, 0, False)]
    assert lineage.lineage(notes.limit(0), resolved.limit(0)).count() == 0


def test_validate_reports_lineage_on_request(spark, tmp_path, capsys):
    for name, text in (("x", "[[y]]"), ("y", "[[x]]"), ("z", "[[gone]]"), ("u", "---\nuid: 1\n---\n"), ("v", "---\nuid: 1\n---\n")):
        (tmp_path / f"{name}.md").write_text(text)
    assert commands.main(["validate", str(tmp_path)], spark) == 0
    assert "LINEAGE" not in capsys.readouterr().out
    assert commands.main(["validate", str(tmp_path), "--lineage"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert [line for line in out if "LINEAGE" in line or "LINK" in line or "IDENTITY" in line] == ["u.md: error OKF-IDENTITY-001: several notes have the uid 1", "x.md: warning OKF-LINEAGE-001: links lead back to the note", "y.md: warning OKF-LINEAGE-001: links lead back to the note", "z.md: warning OKF-LINK-001: link to no note: gone"]


# --- whole front matter

ODD = "---\nuid: 7\nextra:\n  deep: {x: [1, 2.5, true, null]}\nwhen: 2024-05-06T07:08:09Z\n3: three\nnan: .nan\nraw: !!binary aGk=\nset: !!set {b, a}\nbig: 123456789012345678901234567890123456789012345\n---\nbody"


def test_any_field_is_queryable(spark):
    notes = variant.decode_variant(notes_from_rows(spark, [("o.md", ODD)]))
    wanted = {"a": ("$.extra.deep.x[1]", "double"), "b": ("$.extra.deep.x[2]", "boolean"), "c": ("$.extra.deep.x[3]", "string"), "d": ("$.when", "string"), "e": ("$['3']", "string"), "f": ("$.nan", "string"), "g": ("$.raw", "string"), "h": ("$.set[0]", "string"), "i": ("$.uid", "long"), "j": ("$.missing.deep", "string"), "k": ("$.extra", "long"), "l": ("$.big", "double")}
    got = variant.with_fields(notes, wanted).select(*wanted).first().asDict()
    assert got == {"a": 2.5, "b": True, "c": None, "d": "2024-05-06T07:08:09Z", "e": "three", "f": "nan", "g": "aGk=", "h": "a", "i": 7, "j": None, "k": None, "l": pytest.approx(1.2345678901234568e44)}


@pytest.mark.parametrize(("content", "want"), [(None, None), ("", None), ("no fence", None), ("---\n---\nx", "{}"), ("---\n# note\n---\n", "{}"), ("---\n[a, b]\n---\n", None), ("---\na: [b\n---\n", None), ("---\na: &x [*x]\n---\n", None), ("---\na: 1\na: 2\n---\n", '{"a":2}'), ("---\r\na: ü\r\n---\r\n", '{"a":"ü"}')])
def test_odd_blocks(spark, content, want):
    got = variant.decode_variant(notes_from_rows(spark, [("o.md", content)])).select(F.to_json("front_matter")).first()[0]
    assert got == want


def test_anchors_that_repeat_without_end_are_refused():
    bomb = "a: &a [x,x,x,x,x,x,x,x,x]\n" + "".join(f"{chr(98 + i)}: &{chr(98 + i)} [{','.join(['*' + chr(97 + i)] * 9)}]\n" for i in range(8))
    begun = time.time()
    assert variant.block_json(bomb) is None and time.time() - begun < 10


def test_variant_survives_shredded_parquet(spark, tmp_path):
    files = [(f"{i}.md", f"---\nuid: u{i}\nepistemic: {{confidence: 0.{i % 10}, state: fact}}\n{'only: ' + str(i) if i == 3 else 'tags: [a, b]'}\n---\n") for i in range(50)] + [("none.md", "plain")]
    notes = variant.decode_variant(notes_from_rows(spark, files)).drop("content")
    variant.write_shredded(notes.coalesce(1), f"{tmp_path}/v")
    back = variant.read_shredded(spark, f"{tmp_path}/v")
    as_text = [F.col("relative_path"), F.to_json("front_matter")]
    assert rows(back.select(*as_text)) == rows(notes.select(*as_text)) and dict(back.dtypes)["front_matter"] == "variant"
    import pyarrow.parquet as pq

    (file,) = [f for f in os.listdir(tmp_path / "v") if f.endswith(".parquet")]
    assert "typed_value" in str(pq.read_schema(tmp_path / "v" / file).field("front_matter").type)
    asked = back.select(variant.field("front_matter", "$.epistemic.confidence", "double").alias("c"))
    assert "front_matter#" in plan(asked) and "variant_get" not in plan(asked)  # the scan reads the path
    assert asked.agg(F.count("c")).first()[0] == 50
    kinds = {(r["path"], r["kind"]): r["n"] for r in variant.paths(notes).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds[("$.epistemic", "OBJECT")] == 50 and kinds[("$.only", "BIGINT")] == 1 and kinds[("$.epistemic.state", "STRING")] == 50 and kinds[("$.tags", "ARRAY")] == 49


def test_paths_decode_each_note_once(spark):
    """Both levels come from one pass: no second reading for the inner fields, no filter pushed below the decoding."""
    files = [("odd.md", ODD), ("empty.md", "---\na: {}\nb: []\nc:\nd: {x: {y: 1}, z: null}\ne.f: {g.h: x}\n'': {'': 1.5}\n---\n"), ("none.md", "---\n---\n"), ("list.md", "---\n[a]\n---\n"), ("plain.md", "x"), ("null.md", None)]
    found = variant.paths(variant.decode_variant(notes_from_rows(spark, files)))
    assert plan(found).count("ArrowEvalPython") == 1
    got = sorted(tuple(r) for r in found.collect() if r[0] != "odd.md")
    want = {"$.a": "OBJECT", "$.b": "ARRAY", "$.c": "VOID", "$.d": "OBJECT", "$.d.x": "OBJECT", "$.d.z": "VOID", "$.e.f": "OBJECT", "$.e.f.g.h": "STRING", "$.": "OBJECT", "$..": "DECIMAL"}
    assert got == sorted(("empty.md", path, kind) for path, kind in want.items())
    assert {r["path"]: r["kind"] for r in found.collect() if r[0] == "odd.md"} == {"$.uid": "BIGINT", "$.extra": "OBJECT", "$.extra.deep": "OBJECT", "$.when": "STRING", "$.3": "STRING", "$.nan": "STRING", "$.raw": "STRING", "$.set": "ARRAY", "$.big": "DOUBLE"}
    both = variant.decode_variant(notes_from_rows(spark, [("o.md", "---\nfront_matter: 1\n---\n")]), "pos")
    assert [tuple(r) for r in variant.paths(both, front_matter="pos").collect()] == [("o.md", "$.front_matter", "BIGINT")]


# --- change feed


def feed(spark, tmp_path, seen, fail=False, **options):
    """Everything that is new now, a list of (path, change, content) for each batch."""

    def keep(batch, number):
        got = rows(batch.select("relative_path", "change", "content"))
        if fail:
            raise RuntimeError("stop")
        seen.append((number, got))

    stream = changes.read_changes(spark, str(tmp_path / "n"), str(tmp_path / "s"), **options)
    query = stream.writeStream.foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()


def test_edits_and_deletions_arrive_once(spark, tmp_path):
    (tmp_path / "n" / "sub").mkdir(parents=True)
    (tmp_path / "n" / "a.md").write_text("one")
    (tmp_path / "n" / "sub" / "b c.md").write_text("two")
    (tmp_path / "n" / "skip.txt").write_text("x")
    seen = []
    feed(spark, tmp_path, seen, rangeFiles="1")
    assert [g for _, g in seen] == [[("a.md", "added", "one"), ("sub/b c.md", "added", "two")]]
    feed(spark, tmp_path, seen)  # nothing happened
    assert len(seen) == 1
    (tmp_path / "n" / "a.md").write_text("edited")
    (tmp_path / "n" / "sub" / "b c.md").unlink()
    (tmp_path / "n" / "new.md").write_bytes(b"bad \xff byte")
    with pytest.raises(Exception, match="stop"):
        feed(spark, tmp_path, seen, fail=True)
    (tmp_path / "n" / "later.md").write_text("after the failure")
    feed(spark, tmp_path, seen)  # the failed batch again
    feed(spark, tmp_path, seen)  # what came later
    got = [x for _, g in seen[1:] for x in g]
    assert sorted(got) == [("a.md", "changed", "edited"), ("later.md", "added", "after the failure"), ("new.md", "added", "bad � byte"), ("sub/b c.md", "deleted", None)]
    assert len({n for n, _ in seen}) == len(seen)
    assert len(list((tmp_path / "s").glob("manifest-*"))) <= 2


def test_a_replayed_batch_has_the_same_rows(tmp_path):
    (tmp_path / "n").mkdir()
    reader = changes._Stream({"folder": str(tmp_path / "n"), "state": str(tmp_path / "s"), "rangeFiles": "2", "rangeBytes": "5"})
    start = reader.initialOffset()
    assert reader.latestOffset() == start and reader.partitions(start, start) == []
    for name, text in (("a", "12"), ("b", "34"), ("c", "123456"), ("d", "1")):
        (tmp_path / "n" / f"{name}.md").write_text(text)
    end = reader.latestOffset()
    assert end == {"snapshot": 1} == reader.latestOffset()
    planned = [[f for f, _ in p.files] for p in reader.partitions(start, end)]
    assert planned == [["a.md", "b.md"], ["c.md"], ["d.md"]]
    (tmp_path / "n" / "a.md").unlink()
    (tmp_path / "n" / "e.md").write_text("5")
    again = changes._Stream({"folder": str(tmp_path / "n"), "state": str(tmp_path / "s"), "rangeFiles": "2", "rangeBytes": "5"})
    assert [[f for f, _ in p.files] for p in again.partitions(start, end)] == planned
    (gone,) = [b.to_pylist()[0] for p in again.partitions(start, end) for b in again.read(p) if b.to_pylist()[0]["relative_path"] == "a.md"]
    assert gone["change"] == "added" and gone["content"] is None
    last = again.latestOffset()
    (part,) = again.partitions(end, last)
    assert part.files == [("a.md", "deleted"), ("e.md", "added")] and part.noticed > reader.partitions(start, end)[0].noticed
    again.commit(last)
    assert again.manifests.numbers() == [last["snapshot"]]


def test_change_feed_as_a_table_and_its_options(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("one")
    spark.dataSource.register(changes.NoteChanges)
    got = spark.read.format("note_changes").option("folder", str(tmp_path / "n")).load()
    assert rows(got.select("relative_path", "change", "content", "snapshot")) == [("a.md", "added", "one", 0)]
    assert got.where(F.sha2("content", 256) == F.col("content_sha256")).count() == 1
    with pytest.raises(ValueError):
        changes.NoteChanges({}).reader(None)
    with pytest.raises(ValueError):
        changes.NoteChanges({"folder": "x"}).streamReader(None)


# --- keyed state

BASE = datetime(2024, 1, 1, tzinfo=UTC)
VERSIONS = "key string, at timestamp, version string, level int"
HOUR = 3_600_000


def version(key, minutes, name, level):
    return (key, BASE + timedelta(minutes=minutes), name, level)


def run_state(spark, tmp_path, batches, **kw):
    """Each list of versions as one batch; the query is stopped and started again after each."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = state.track(spark.readStream.schema(VERSIONS).parquet(f"{tmp_path}/in"), **kw)
            query = stream.writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
            query.awaitTermination()
            assert query.exception() is None, i
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return sorted(out, key=str)


def test_state_is_that_of_the_table(spark, tmp_path):
    first = [version("a", 0, "x", 1), version("a", 30, "y", 1), version("b", 5, "p", 3), (None, BASE, "n", 1), ("n", None, "n", 1)]
    second = [version("a", 27, "x", 1), version("a", 30, "y", 1), version("b", 40, "p", 2), version("a", 35, "y", 4)]  # late, repeated
    third = [version("b", 55, None, None), version("c", 300, "end", 1)]
    dropped = [version("a", 1, "too late", 9)]  # behind the watermark, which is some 4 hours on
    last = [version("c", 900, "end", 1)]
    kw = {"stale_ms": HOUR, "forget_ms": 4 * HOUR}
    got = run_state(spark, tmp_path, [first, second, third, dropped, last], late="10 minutes", **kw)
    table = spark.createDataFrame(first + second + third, VERSIONS)
    want = rows(state.history(table, until=BASE + timedelta(minutes=890), **kw))
    assert got == want and {r[1] for r in got} == {"first", "edited", "raised", "lowered", "deleted", "stale"}
    assert "too late" not in str(got)


def test_state_of_random_versions(spark, tmp_path):
    rng = random.Random(4)
    made = sorted((version(f"k{rng.randrange(4)}", rng.randrange(1200) + rng.random(), rng.choice(["x", "y", "z", None]), rng.randrange(3)) for _ in range(120)), key=lambda v: v[1])
    batches = [sorted(made[i : i + 40], key=lambda _: rng.random()) for i in range(0, 120, 40)]
    end = [version("end", 5000, "x", 1)]
    kw = {"stale_ms": HOUR, "forget_ms": 5 * HOUR}
    got = [r for r in run_state(spark, tmp_path, [*batches, end, [version("end", 9000, "x", 1)]], late="2 hours", **kw) if r[0] != "end"]
    assert got == rows(state.history(spark.createDataFrame(made, VERSIONS), until=BASE + timedelta(minutes=8000), **kw))
    with pytest.raises(ValueError):
        state.track(spark.createDataFrame(made, VERSIONS), stale_ms=5, forget_ms=5)


def test_state_of_a_note_folder(spark, tmp_path):
    """From files to events: labels are judged under the options, deletions are seen, a restart goes on."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    note, out = tmp_path / "n" / "a.md", []
    note.parent.mkdir()

    def step():
        feed = changes.read_changes(spark, str(tmp_path / "n"), str(tmp_path / "s"))
        stream = state.track(state.note_versions(feed, Options("internal", flat=True)), late="0 seconds", stale_ms=10**9, forget_ms=10**10)
        query = stream.writeStream.foreachBatch(lambda b, _: out.extend((r["key"], r["event"], r["level"]) for r in b.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        query.awaitTermination()

    try:
        for text in ("no label", "---\nsensitivity: phi\n---\n", "---\nsensitivity: phi\n---\nmore", "---\nsensitivity: public\n---\n", None, "---\nsensitivity: secret\n---\n"):
            if text is None:
                note.unlink()
            else:
                note.write_text(text)
            step()
        for name in ("end.md", "later.md"):  # move the watermark on
            (tmp_path / "n" / name).write_text("x")
            step()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert [x for x in out if x[0] == "a.md"] == [("a.md", "first", 2), ("a.md", "raised", 6), ("a.md", "edited", 6), ("a.md", "lowered", 1), ("a.md", "deleted", None), ("a.md", "first", 7)]


# --- windows

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event(i, minutes, user=1, kind="view", value=1.0):
    return (i, BASE + timedelta(minutes=minutes), user, kind, value)


def streamed(spark, tmp_path, batches, make, mode="append"):
    """What comes out of a stream of batches."""
    out = []
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = make(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")).writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
        query.awaitTermination()
    return sorted(out, key=str)


def naive(minutes):
    return (BASE + timedelta(minutes=minutes)).replace(tzinfo=None)


def test_sessions_drop_late_rows(spark, tmp_path):
    batches = [[event(1, 0), event(2, 20), event(3, 100, 2)], [event(4, 300)], [event(5, 25), event(6, 700)], [event(7, 1400)]]
    got = streamed(spark, tmp_path, batches, lambda s: windows.sessions(s, "30 minutes", "10 minutes"))
    in_time = [r for b in batches for r in b if r[0] != 5]  # 5 would have made the first session longer
    table = windows.sessions(spark.createDataFrame(in_time, EVENTS), "30 minutes")
    assert got == [r for r in rows(table) if r[1] != naive(1400)] and (1, naive(0), naive(50), 2, 2.0) in got
    assert rows(windows.sessions(spark.createDataFrame([r for b in batches for r in b], EVENTS), "30 minutes"))[0][3] == 3


def test_session_gaps_of_their_own(spark):
    table = spark.createDataFrame([event(1, 0, kind="call"), event(2, 50), event(3, 70), event(4, 71, 2)], EVENTS)
    gap = F.when(F.col("event_type") == "call", "60 minutes").otherwise("10 minutes")
    assert rows(windows.sessions(table, gap).select("user_id", "session_start", "n")) == [(1, naive(0), 2), (1, naive(70), 1), (2, naive(71), 1)]


def test_sliding_windows_drop_late_rows(spark, tmp_path):
    batches = [[event(1, 0, value=2.0), event(2, 50)], [event(3, 400)], [event(4, 10), event(5, 900)]]
    got = streamed(spark, tmp_path, batches, lambda s: windows.sliding(s, "1 hour", "30 minutes", "10 minutes"))
    table = windows.sliding(spark.createDataFrame([batches[0][0], batches[0][1], batches[1][0]], EVENTS), "1 hour", "30 minutes")
    assert got == rows(table) and (naive(0), "view", 2, 3.0) in got and (naive(-30), "view", 1, 2.0) in got


def test_follow_ups_of_streams(spark, tmp_path):
    batches = [[event(1, 0), event(2, 10, 2), event(3, 20, kind="buy")], [event(4, 500), event(5, 500, kind="buy")], [event(6, 30, 2, "buy"), event(7, 1200), event(8, 1200, kind="buy")]]

    def make(s):
        return windows.follow_ups(s.where("event_type = 'view'"), s.where("event_type = 'buy'"), "1 hour", "10 minutes").select("user_id", "event_id", "followed_by")

    got = streamed(spark, tmp_path, batches, make)
    assert (1, 1, 3) in got and (2, 2, None) in got  # the late partner of 2 was dropped
    whole = make(spark.createDataFrame([r for b in batches for r in b], EVENTS))
    assert (2, 2, 6) in rows(whole) and (1, 4, None) in rows(whole)


# --- proposals over HTTP


class Helper(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Helper.asked.append((self.path, body, self.headers.get("authorization"), self.headers["content-type"]))
        task = body["targetId"]
        if task == "slow.md":
            time.sleep(3)
        if task == "moved.md":
            self.send_response(302)
            self.send_header("location", "http://example.com/")
            self.end_headers()
            return
        self.send_response({"refused.md": 403, "odd.md": 500}.get(task, 200))
        self.end_headers()
        answer = {"refused.md": '{"error": "not today"}', "odd.md": "<html>", "broken.md": "no json", "list.md": "[1]"}.get(task, json.dumps({"requestId": body["requestId"], "proposals": []}))
        self.wfile.write(answer.encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def helper():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Helper)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Helper.asked = []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def asking(spark, *targets):
    return spark.createDataFrame([("1.0", f"request:{t}", "relationship", t, "text", None) for t in targets], "contractVersion string, requestId string, task string, targetId string, noteText string, effectiveSensitivity string")


def test_proposals_are_asked_for_once(spark, helper, tmp_path):
    targets = ["a.md", "refused.md", "odd.md", "broken.md", "list.md", "slow.md", "moved.md"]
    out = live.fetch(asking(spark, *targets).repartition(3), helper, str(tmp_path / "spool"), " k1 ".strip(), seconds=1)
    first = {r["request_id"].removeprefix("request:"): r for r in out.collect()}
    assert {k: (r["outcome"], r["status"]) for k, r in first.items()} == {"a.md": ("ok", 200), "refused.md": ("rejected", 403), "odd.md": ("rejected", 500), "broken.md": ("malformed", 200), "list.md": ("malformed", 200), "slow.md": ("unavailable", None), "moved.md": ("rejected", 302)}
    assert first["refused.md"]["message"] == "not today" and first["odd.md"]["message"] == "unknown error" and "timed out" in first["slow.md"]["message"]
    assert {a[0] for a in Helper.asked} == {"/v1/proposals"} and {a[2] for a in Helper.asked} == {"Bearer k1"} and {a[3] for a in Helper.asked} == {"application/json"}
    sent = len(Helper.asked)
    assert sent == len(targets) and "effectiveSensitivity" not in Helper.asked[0][1]
    again = {r["request_id"].removeprefix("request:"): r for r in out.collect()}  # every task runs again
    assert again == first and len(Helper.asked) == sent
    (tmp_path / "spool" / next(f for f in os.listdir(tmp_path / "spool") if f.endswith(".answer"))).unlink()
    assert [r["outcome"] for r in out.collect()].count("interrupted") == 1 and len(Helper.asked) == sent


def test_live_assistance_from_the_command_line(spark, helper, tmp_path, capsys, monkeypatch):
    def proposal(body, **more):
        return {"contractVersion": body["contractVersion"], "proposalId": "p1", "proposalType": body["task"], "targetId": body["targetId"], "rationale": "r", "confidence": 0.8, "evidenceRefs": [], "generator": {"system": "t", "programVersion": "1"}} | more

    real = Helper.do_POST

    def answer(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Helper.asked.append((self.path, body, self.headers.get("authorization"), None))
        more = {"unsafe.md": {"proposedPatch": {"approved": True}}, "other.md": {"targetId": "elsewhere.md"}}.get(os.path.basename(body["targetId"]), {})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"contractVersion": body["contractVersion"], "requestId": body["requestId"], "proposals": [proposal(body, **more)]}).encode())

    monkeypatch.setattr(Helper, "do_POST", answer)
    monkeypatch.setenv(commands.TOKEN, " k2 ")
    monkeypatch.setenv(commands.URL, helper)
    for name in ("good.md", "unsafe.md", "other.md"):
        (tmp_path / name).write_text("# Alpha")
    assert commands.main(["assist", "improve", str(tmp_path / "good.md"), "--live"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["authoritative"] is False and [p["proposalId"] for p in made["proposals"]] == ["p1"] and made["proposals"][0]["proposalType"] == "documentation_improvement"
    assert Helper.asked[0][1]["noteText"] == "# Alpha" and Helper.asked[0][2] == "Bearer k2"
    for name, why in (("unsafe.md", "claims authority"), ("other.md", "another note")):
        assert commands.main(["assist", "repair", str(tmp_path / name), "--live"], spark) == 2
        assert why in capsys.readouterr().err
    assert commands.main(["assist", "repair", str(tmp_path / "good.md"), "--live", "--url", "http://example.com"], spark) == 2 and "loopback" in capsys.readouterr().err
    assert commands.main(["assist", "repair", str(tmp_path / "good.md"), "--live", "--url", "http://127.0.0.1:9"], spark) == 2 and "unavailable" in capsys.readouterr().err
    monkeypatch.setattr(Helper, "do_POST", real)
    assert len(Helper.asked) == 3 and (tmp_path / "good.md").read_text() == "# Alpha"


def test_proposals_without_token_or_server(spark, helper, tmp_path):
    assert live.fetch(asking(spark, "a.md"), helper, str(tmp_path / "s")).first()["outcome"] == "ok" and Helper.asked[0][2] is None
    gone = live.fetch(asking(spark, "b.md"), "http://127.0.0.1:9", str(tmp_path / "s")).first()
    assert (gone["outcome"], gone["status"]) == ("unavailable", None)
    assert live.fetch(asking(spark, "c.md").withColumn("requestId", F.lit(None).cast("string")), helper, str(tmp_path / "s")).first()["outcome"] == "unsent"
    for url in ("http://example.com", "https://127.0.0.1.example.com", "ftp://127.0.0.1", "http://u:p@127.0.0.1", "http://localhost@example.com", "file:///x"):
        with pytest.raises(ValueError, match="loopback"):
            live.fetch(asking(spark, "d.md"), url, str(tmp_path / "s"))
    assert live.local_url("http://[::1]:9") == "http://[::1]:9/v1/proposals"


# --- joins by time


def test_asof(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([1, 2, 3, None]), BASE + timedelta(hours=rng.randrange(200)) if rng.random() > 0.1 else None) for i in range(120)]
    right = [(rng.choice([1, 2, 4, None]), BASE + timedelta(hours=rng.randrange(200)) if rng.random() > 0.1 else None, rng.randrange(9)) for _ in range(60)]
    for bucket in (1, 3, 1000):
        out = joins.asof(spark.createDataFrame(left, "i int, k int, t timestamp"), spark.createDataFrame(right, "k int, at timestamp, v int"), ["k"], "t", "at", bucket)
        want = []
        for i, k, t in left:
            before = [(a, v) for q, a, v in right if k is not None and t is not None and q == k and a is not None and a <= t]
            a, v = max(before, default=(None, None))
            want.append((i, k, t and t.replace(tzinfo=None), a and a.replace(tzinfo=None), v))
        assert rows(out) == sorted(want, key=str) and out.columns == ["i", "k", "t", "last_at", "last_v"]
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    none = joins.asof(spark.createDataFrame(left, "i int, k int, t timestamp"), spark.createDataFrame([], "k int, at timestamp, v int"), ["k"], "t", "at")
    assert none.count() == len(left) and none.where("last_v IS NOT NULL").count() == 0


def test_overlapping_periods(spark):
    rng = random.Random(5)

    def periods(n):
        out = []
        for i in range(n):
            a = rng.randrange(5000)
            out.append((i, rng.choice([1, 2, None]), BASE + timedelta(minutes=a), BASE + timedelta(minutes=a + rng.choice([0, 1, 30, 60, 61, 600, 90_000, -5]))))
        return [*out, (n, 1, None, BASE), (n + 1, 1, BASE, None), (n + 2, 1, BASE - timedelta(days=900), BASE + timedelta(days=900))]

    a, b = periods(60), periods(40)
    schema = "i int, k int, s timestamp, e timestamp"
    out = joins.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], ("s", "e"), ("s", "e"), base=600)
    assert out.columns == ["i", "k", "s", "e", "right_i", "right_s", "right_e"]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (*x[2:], *y[2:]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["i"], r["right_i"]) for r in out.collect()) == want
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    empty = spark.createDataFrame([], schema)
    assert joins.overlapping(empty, empty, ["k"], ("s", "e"), ("s", "e")).count() == 0


# --- groupings, outlines, views, sketches

PRIVATE = [(f"{level}/{i}.md", f'---\nuid: "{level}{i}"\nsensitivity: {level}\nepistemic_state: fact\n---\nhidden words of {level}') for level in ("public", "restricted", "secret") for i in range(3)] + [("plain.md", "x"), ("odd.md", "---\nsensitivity: odd\n---\n")]


def test_groupings(spark):
    p = project(notes_from_rows(spark, PRIVATE), Options(flat=True))
    flat = rows(validate.report(p).select("severity", "code", F.when(F.instr("relative_path", "/") > 0, F.substring_index("relative_path", "/", 1)).otherwise("")))
    for how, sets in (("cube", list(range(8))), ("rollup", [0, 1, 3, 7]), ("sets", [3, 5, 6, 7])):
        want = {}
        for g in sets:
            for row in flat:
                key = (*(None if g >> (2 - i) & 1 else v for i, v in enumerate(row)), g)
                want[key] = want.get(key, 0) + 1
        made = validate.summary_sets(p, how)
        assert {tuple(r)[:4]: r["n"] for r in made.collect()} == want
        text = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert text.count("Expand ") == 1 and text.count("Exchange ") == 1, text
    with pytest.raises(ValueError):
        validate.summary_sets(p, "odd")


BODY = """---
uid: x
---
[[top|t]]
# One #
text [[a.md#h]]
- [ ] first [[b]]
  - [x] inner
    - [X] deepest
      more [[c]]
  - plain item
- [ ] second
paragraph [[d]]
```python
# no heading [[no]]
- [ ] no task
~~~
```
### Three
## Two
[[e]]
#nohash
"""


def test_outline(spark):
    got = [tuple(r)[1:] for r in outlines.outline(notes_from_rows(spark, [("n.md", BODY)])).orderBy("nth").collect()]
    assert got == [
        (1, 1, "link", None, None, "top|t", "top", None), (2, 2, "heading", 1, None, "One", None, None), (3, 3, "link", None, 2, "a.md#h", "a", None), (4, 4, "task", 1, 2, "first [[b]]", None, False),
        (5, 4, "link", None, 4, "b", "b", None), (6, 5, "task", 2, 4, "inner", None, True), (7, 6, "task", 3, 6, "deepest", None, True), (8, 7, "link", None, 7, "c", "c", None), (9, 9, "task", 1, 2, "second", None, False),
        (10, 10, "link", None, 2, "d", "d", None), (11, 16, "heading", 3, 2, "Three", None, None), (12, 17, "heading", 2, 2, "Two", None, None), (13, 18, "link", None, 12, "e", "e", None),
    ]


def test_outline_in_sql(spark):
    outlines.register(spark)
    notes = spark.createDataFrame([("a.md", "# A\n[[x]]"), ("b.md", None), ("c.md", ""), (None, "# N"), ("a.md", "# A")], "relative_path string, body string").repartition(16)
    notes.createOrReplaceTempView("outlined")
    got = spark.sql("SELECT o.kind, count(*) FROM note_outline(TABLE(outlined) PARTITION BY relative_path) AS o GROUP BY 1")
    assert rows(got) == [("heading", 3), ("link", 1)]
    joined = spark.sql("SELECT f.v, o.text FROM VALUES (1), (2) AS f(v), LATERAL (SELECT * FROM note_outline(TABLE(SELECT relative_path, body FROM outlined WHERE body LIKE '%x%') PARTITION BY relative_path)) AS o WHERE o.kind = 'link'")
    assert rows(joined) == [(1, "x"), (2, "x")]
    assert spark.sql("SELECT * FROM note_outline(TABLE(SELECT * FROM outlined WHERE false) PARTITION BY relative_path)").collect() == []


def test_no_view_shows_more_than_its_ceiling(spark, tmp_path):
    views.store(project(notes_from_rows(spark, PRIVATE), Options("internal")), f"{tmp_path}/flat")
    names = views.register(spark, spark.read.parquet(f"{tmp_path}/flat"), "seen_by_")
    want = {"public": {"public"}, "internal": {"public", "internal"}, "restricted": {"public", "internal", "restricted"}, "phi": {"public", "internal", "restricted"}, "secret": {"public", "internal", "restricted", "secret"}}
    for ceiling, levels in want.items():
        assert {r[0] for r in views.ask(spark, ceiling, "SELECT DISTINCT sensitivity FROM {notes}", names).collect()} == levels, ceiling
    for query, args in (("SELECT count(*) FROM {notes} WHERE uid = :uid", {"uid": "secret1"}), ("SELECT count(*) FROM {notes} WHERE sensitivity_rank >= :top OR true IS NULL", {"top": 7}), ("SELECT count(*) FROM {notes} WHERE uid = :uid OR 1 = 0", {"uid": "x' OR '1'='1"})):
        assert views.ask(spark, "phi", query, names, **args).first()[0] == 0
    assert views.ask(spark, "bogus", "SELECT count(*) FROM {notes}", names).first()[0] == 3
    assert "content" not in spark.table(names["secret"]).columns
    seen = plan(spark.table(names["restricted"]).select("uid"))
    assert "LessThanOrEqual(sensitivity_rank,3)" in seen and "ReadSchema: struct<uid:string,sensitivity_rank:int>" in seen
    assert rows(views.seen_by(project(notes_from_rows(spark, PRIVATE)), "public").select("sensitivity").distinct()) == [("public",)]


def test_sketches_merge(spark):
    day = F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("id") % 5 + 1).cast("string")))
    things = spark.range(60_000).select(day.alias("t"), (F.col("id") % 3).alias("k"), (F.col("id") % 20_000).alias("x"))
    kept = sketches.daily(things, F.col("t"), F.col("k"), F.col("x"))
    assert kept.count() == 15
    whole = sketches.merged(kept).first()
    assert abs(whole["estimate"] - 20_000) < 600 and whole["n"] == 60_000
    parts = [sketches.daily(things.where(c), F.col("t"), F.col("k"), F.col("x")) for c in ("x < 9000", "x >= 8000")]  # rows in both
    both = sketches.extended(*parts)
    assert both.count() == 15 and abs(sketches.merged(both).first()["estimate"] - 20_000) < 600
    assert abs(sketches.merged(kept, "day").agg(F.min("estimate")).first()[0] - 4_000) < 200
    assert sketches.daily(things.withColumn("x", F.lit(None)), F.col("t"), F.col("k"), F.col("x")).count() == 0
