"""The command line: four deterministic commands over a folder, and offline assistance."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import __version__
from quillmark.operators import assess, graph, lineage, proposals, settings, validate
from quillmark.operators.projection import Options, project
from quillmark.sources import live
from quillmark.sources.notes import read_notes, read_one
from quillmark.sources.shared import once
from quillmark.streaming.supervise import Supervisor
from quillmark.streaming.watch import watch

USAGE = "commands: validate, assess, graph, export graphiti, assist"
EXAMPLES = "assist explain note.md > asked.jsonl | assist repair note.md --requests asked.jsonl --responses answers.jsonl | assist improve note.md --live; a note is never changed"
#: Where the live helper is, and its token, unless options say so.
URL, TOKEN = "QUILLMARK_ASSIST_URL", "QUILLMARK_ASSIST_TOKEN"
DEFAULT_URL = "http://127.0.0.1:8765"
#: The parts of a graph file, in its order.
_PARTS = (("diagnostic", "diagnostics"), ("link", "links"), ("node", "nodes"), ("stats", "stats"))


def allowed(argv: list[str]) -> bool:
    """Whether a command line names one of the deterministic commands."""
    return argv[:1] in (["validate"], ["assess"], ["graph"]) or argv[:2] == ["export", "graphiti"]


def build_line(notes: DataFrame, options: Options) -> str:
    """The build block as JSON with ordered keys."""
    block = assess.build_block(notes, options, __version__)
    at = F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at")
    return block.select(F.to_json(F.struct("corpus_hash", "engine_version", at, "policy_hash"))).first()[0]


def settled(notes: DataFrame, options: Options) -> DataFrame:
    """The projection with links and content hash but without contents, computed once for all that a command prints."""
    out = graph.linked(project(notes, options)).withColumn("content_sha256", F.sha2(F.coalesce("content", F.lit("")), 256))
    return once(out.select("relative_path", "has_front_matter", "front_matter_valid", "authored", "effective", "diagnostics", "links", "content_sha256"))


def write_lines(lines: DataFrame, path: str, first: str) -> None:
    """One local file: the build line, then ordered ``line`` rows, streamed through the driver a partition at a time; it takes the place of an earlier one when complete."""
    with open(f"{path}.part", "w", encoding="utf-8") as out:
        out.write(json.dumps({"build": json.loads(first)}, sort_keys=True) + "\n")
        for r in lines.toLocalIterator():
            out.write(r["line"] + "\n")
    os.replace(f"{path}.part", path)


def write_graph(notes: DataFrame, options: Options, path: str) -> None:
    """The graph as one JSON document with ordered keys, streamed as ``write_lines`` does."""
    notes = notes if "links" in notes.columns else settled(notes, options)
    rows = graph.graph_json(notes).orderBy("kind", "key")
    with open(f"{path}.part", "w", encoding="utf-8") as out:
        out.write(f'{{"build": {build_line(notes, options)}')
        now, left = None, list(_PARTS)
        for r in rows.toLocalIterator():
            while now != r["kind"]:
                if now not in (None, "stats"):
                    out.write("]")
                now, name = left.pop(0)
                out.write(f',\n"{name}": ' + ("" if now == "stats" else "["))
                lead = ""
            out.write(lead + r["json"])
            lead = ",\n"
        out.write("}\n")
    os.replace(f"{path}.part", path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmark", description=f"quillmark {__version__}; {USAGE}")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("validate", "assess", "graph"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        p.add_argument("--default-sensitivity")
        if name == "validate":
            p.add_argument("--lineage", action="store_true", help="also report dangling links, identities that several notes bear, and notes that links lead back to; these don't fail the gate")
        if name == "assess":
            p.add_argument("--json", action="store_true")
        if name == "graph":
            p.add_argument("-o", "--output", required=True)
            p.add_argument("--watch", action="store_true", help="go on and rebuild whenever a note changes")
            p.add_argument("--state", help="folder for the watch's snapshots, shared by all executors (default: beside the output)")
            p.add_argument("--settings", help="settings file whose folder and default sensitivity hold while watching; a change starts the watch anew")
            p.add_argument("--status", help="status file, written after every build")
    p = sub.add_parser("export")
    p.add_argument("what", choices=["graphiti"])
    p.add_argument("folder")
    p.add_argument("--episodes", required=True)
    p.add_argument("--group-id")
    p = sub.add_parser("assist")
    p.add_argument("task")
    p.add_argument("note")
    p.add_argument("--responses", help="JSON lines of responses to earlier requests for this task and note")
    p.add_argument("--requests", help="the requests that --responses answer, as they were printed")
    p.add_argument("--live", action="store_true", help="ask a helper on this machine over HTTP")
    p.add_argument("--url", help=f"the helper's loopback URL (default: ${URL} or {DEFAULT_URL})")
    p.add_argument("--spool", help="folder for sent requests and their answers, shared by all executors (default: beside the note)")
    p.add_argument("--contract-version", default=proposals.CONTRACT)
    return top


def assist(spark: SparkSession, args: argparse.Namespace) -> int:
    """Prints the request to be answered; or, given responses or asking live, what passes the checks."""
    if args.responses and not args.requests:
        print("--responses needs --requests, the requests that they answer", file=sys.stderr)
        return 2
    note = read_one(spark, args.note)
    asked = once(proposals.requests(note, args.task, contract=args.contract_version))  # its id is random
    first = asked.first()  # one note
    if first is None:
        print(f"unknown task: {args.task}", file=sys.stderr)
        return 2
    if args.live:
        return _live(spark, args, asked)
    if not args.responses:
        print(asked.toJSON().first())
        return 0
    saved = proposals.read_requests(spark, args.requests).where((F.col("task") == first["task"]) & (F.col("target_id") == first["targetId"]))
    return _hand_on(proposals.check(proposals.read_responses(spark, args.responses), saved, args.contract_version), args.contract_version)


def _live(spark: SparkSession, args: argparse.Namespace, asked: DataFrame) -> int:
    url = args.url or os.environ.get(URL) or DEFAULT_URL
    try:
        answers = once(live.fetch(asked, url, args.spool or f"{args.note}.spool", (os.environ.get(TOKEN) or "").strip() or None))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    failed = answers.where("outcome <> 'ok'").first()
    if failed is not None:
        why = {"rejected": f"the helper rejected the request ({failed['status']})", "unavailable": "the optional helper is unavailable"}.get(failed["outcome"], failed["outcome"])
        print(f"{why}: {failed['message']}", file=sys.stderr)
        return 2
    known = asked.select(F.col("requestId").alias("request_id"), "task", F.col("targetId").alias("target_id"))
    return _hand_on(proposals.check(answers.select("request_id", "body"), known, args.contract_version), args.contract_version)


def _hand_on(checked: DataFrame, contract: str) -> int:
    """Prints the accepted proposals of each request, or why there are none."""
    checked, failed = once(checked), 0
    results = {r["request_id"]: r for r in proposals.outcome(checked).toLocalIterator()}
    for r in proposals.document(checked, contract).orderBy("request_id").toLocalIterator():
        if results[r["request_id"]]["status"] == "error":
            failed = 2
            print(f"no safe proposals:\n{results[r['request_id']]['warnings']}", file=sys.stderr)
        else:
            print(r["json"])
    return failed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        print(USAGE)
        return 1
    if argv[0] in ("-h", "--help"):
        print(USAGE)
        return 0
    if argv[0] == "assist" and len([a for a in argv if not a.startswith("-")]) < 3:
        print(EXAMPLES, file=sys.stderr)
        return 2
    if argv[0] != "assist" and not allowed(argv):
        print(f"unsupported command; {USAGE}", file=sys.stderr)
        return 1
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillmark").getOrCreate()
    if args.command == "assist":
        return assist(spark, args)
    options = Options(getattr(args, "default_sensitivity", None))
    notes = read_notes(spark, args.folder)
    projection = settled(notes, options)
    if args.command == "validate":
        for r in validate.report(projection).orderBy("relative_path", "code", "field").toLocalIterator():
            print(f"{r['relative_path']}: {r['severity']} {r['code']}: {r['message']}")
        for r in validate.summary(projection).orderBy("severity", "code").toLocalIterator():
            print(f"{r['n']:6d} {r['severity']} {r['code']}")
        if args.lineage:
            resolved = graph.resolve(graph.links(projection), projection)
            found = graph.diagnostics(projection).unionByName(lineage.diagnostics(lineage.lineage(projection, resolved)))
            for r in found.orderBy("subject", "code", "message").toLocalIterator():
                print(f"{r['subject']}: {r['severity']} {r['code']}: {r['message']}")
        row = validate.gate(projection).first()
        print(f"{row['notes']} notes, {row['failures']} failures")
        print(f"build: {build_line(projection, options)}")
        return row["exit_code"]
    if args.command == "assess":
        rows = assess.assess(projection).orderBy("relative_path")
        if args.json:
            print("[" + ",\n".join(r["j"] for r in rows.select(F.to_json(F.struct("label", "relative_path", "score")).alias("j")).toLocalIterator()) + "]")
        else:
            for r in rows.toLocalIterator():
                print(f"{r['score']:3d} {r['label']:5s} {r['relative_path']}")
        print(f"build: {build_line(projection, options)}", file=sys.stderr if args.json else sys.stdout)
    elif args.command == "graph":
        write_graph(projection, options, args.output)
        if args.watch:
            keep_watching(spark, args, options)
    else:
        out = assess.episodes(projection, args.group_id).orderBy("source", "uid")
        write_lines(out.select(F.to_json(F.struct(*sorted(out.columns))).alias("line")), args.episodes, build_line(projection, options))
    return 0


def policy(spark: SparkSession, args: argparse.Namespace, options: Options) -> tuple[str, Options]:
    """The folder and options that hold now: those of the settings file, where one is named, before those of the command line."""
    if not args.settings:
        return args.folder, options
    now = settings.load(spark, args.settings)
    return now["notes_dir"] or args.folder, Options(now["default_sensitivity"])


def write_status(notes: DataFrame, folder: str, options: Options, state: str, path: str) -> None:
    """The status document: what is watched under which policy, how many notes there are, when they were last read."""
    counted = assess.status(notes).first().asDict()
    made = {"pid": os.getpid(), "notes_dir": folder, "default_sensitivity": options.default, "state": state} | counted
    with open(f"{path}.part", "w", encoding="utf-8") as out:
        json.dump(made, out, indent=2, sort_keys=True)
    os.replace(f"{path}.part", path)


def keep_watching(spark: SparkSession, args: argparse.Namespace, options: Options, seconds: int = 5) -> None:
    """Rebuilds the graph on every change until interrupted or restarts are used up. A change of policy starts the watch anew, which builds the graph under it from all notes."""
    state = args.state or f"{args.output}.state"
    folder, now = policy(spark, args, options)
    began = [False]

    def build(notes: DataFrame) -> None:
        write_graph(notes, now, args.output)
        if args.status:
            write_status(notes, folder, now, "serving", args.status)

    def start():
        if not began[0]:  # a policy that has not been built under yet
            build(read_notes(spark, folder))
            began[0] = True
        return watch(spark, folder, lambda _changes, notes, _batch: build(notes), state, seconds)

    keeper = Supervisor(start)
    keeper.start()
    try:
        while keeper.tend() in ("indexing", "serving"):
            if keeper.query is not None:
                keeper.query.awaitTermination(seconds)
            if (then := policy(spark, args, options)) != (folder, now):
                keeper.stop()
                (folder, now), began[0] = then, False
                keeper.start()
    except KeyboardInterrupt:
        pass
    finally:
        keeper.stop()


if __name__ == "__main__":
    sys.exit(main())
