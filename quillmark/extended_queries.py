"""Registered queries of lineage, whole front matter, state, windows, joins by time, groupings, outlines, views and sketches, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.composed_sql import COMPOSED, VARIED
from quillmark.functions import outline as outlines
from quillmark.functions import variant
from quillmark.operators import graph, joins, lineage, sketches, validate, views
from quillmark.operators.projection import Options, project
from quillmark.sources.notes import notes_from_documents, varied_notes_from_documents
from quillmark.streaming import state, windows

FLAT = Options(flat=True)
MONEY = "decimal(18,4)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resolved(s, d):
    notes = notes_from_documents(_table(s, d, "documents"))
    return notes, graph.resolve(graph.links(notes), notes)


def note_ancestors(s, d):
    return lineage.ancestors(_resolved(s, d)[1])


def note_lineage(s, d):
    return lineage.lineage(*_resolved(s, d))


def note_lineage_diagnostics(s, d):
    return lineage.diagnostics(lineage.lineage(*_resolved(s, d))).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first"))


def varied_variant_fields(s, d):
    """Fields of the whole front matter by their paths, those that the typed projection does not know among them."""
    notes = variant.decode_variant(varied_notes_from_documents(_table(s, d, "documents")))
    fields = {"confidence": ("$.epistemic.confidence", "double"), "first_handling": ("$.sensitivity.handling[0]", "string"), "second_tag": ("$.tags[1]", "string"), "provenance_level": ("$.provenance.level", "string"), "version": ("$.okf_version", "string"), "uid": ("$.uid", "string")}
    return variant.with_fields(notes, fields).select("relative_path", F.col("front_matter").isNotNull().alias("decoded"), *fields)


def varied_variant_paths(s, d):
    """Which fields notes have, and of what kind."""
    notes = variant.decode_variant(varied_notes_from_documents(_table(s, d, "documents")))
    return variant.paths(notes).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def _versions(s, d):
    """Each user's events as versions of a note: the kind is the version, the value's tens its level."""
    e = _table(s, d, "events")
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("version"), F.floor(F.col("value") / 20).cast("int").alias("level"))


def note_state_history(s, d):
    out = state.history(_versions(s, d), until=F.lit("2024-01-31 00:00:00"), stale_ms=4 * 3_600_000, forget_ms=48 * 3_600_000)
    return out.select("key", "event", F.col("at").cast("timestamp_ntz").alias("at"), "version", "level")


def event_sliding(s, d):
    out = windows.sliding(_table(s, d, "events").withColumn("value", F.col("value").cast(MONEY)), "6 hours", "2 hours")
    return out.select("window_start", "event_type", "n", F.col("total").cast("double").alias("total"))


def event_sessions(s, d):
    out = windows.sessions(_table(s, d, "events").withColumn("value", F.col("value").cast(MONEY)), "90 minutes")
    return out.select("user_id", "session_start", "session_end", "n", F.col("total").cast("double").alias("total"))


def event_follow_ups(s, d):
    e = _table(s, d, "events")
    out = windows.follow_ups(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "12 hours")
    return out.select("user_id", "event_id", F.coalesce("followed_by", F.lit(-1)).alias("followed_by"))


def event_asof_view(s, d):
    """Each purchase with its user's last view before it."""
    e = _table(s, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("view_id"), F.col("value").alias("price"))
    return joins.asof(bought, seen, ["user_id"], "ts", "seen_at").select("event_id", F.coalesce("last_view_id", F.lit(-1)).alias("last_view_id"), "last_price")


def lineitem_asof_order(s, d):
    """Each line with the last order, at most from its shipping day, of the customer who ordered it."""
    o, li = _table(s, d, "orders"), _table(s, d, "lineitem")
    shipped = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("cust"), "l_shipdate")
    placed = o.groupBy(F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("order"))
    return joins.asof(shipped, placed, ["cust"], "l_shipdate", "day", 90).select("l_orderkey", "l_linenumber", F.coalesce("last_order", F.lit(-1)).alias("last_order"))


def _periods(s, d):
    """Runs of each user's events, and the times between one error of a user and the next."""
    e = _table(s, d, "events")
    runs = windows.sessions(e, "5 hours").select("user_id", F.col("session_start").alias("run_start"), (F.col("session_end") - F.expr("INTERVAL 5 HOURS")).alias("run_end"))
    nth = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    quiet = e.select("user_id", "event_id", "event_type", F.col("ts").alias("quiet_start"), F.lead("ts").over(nth).alias("quiet_end")).where("event_type = 'error'")
    return runs, quiet.drop("event_type")


def event_overlaps(s, d):
    """How many times between errors each run of events overlaps, and the first of them."""
    out = joins.overlapping(*_periods(s, d), ["user_id"], ("run_start", "run_end"), ("quiet_start", "quiet_end"))
    out = out.groupBy("user_id", "run_start").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return out.select("user_id", "run_start", "n", "first")


def note_diagnostics_cube(s, d):
    notes = varied_notes_from_documents(_table(s, d, "documents"))
    again = notes_from_documents(_table(s, d, "documents"))
    return validate.summary_sets(project(notes.unionByName(again), FLAT))


def note_diagnostics_rollup(s, d):
    return validate.summary_sets(project(varied_notes_from_documents(_table(s, d, "documents"))), "rollup")


def _outlined(s, d):
    """Notes whose bodies hold headings, tasks and links between the words of the documents."""
    docs = _table(s, d, "documents")
    k = F.col("doc_id").cast("string")
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"[A-Za-z]+", 0)
    lines = [F.concat(F.lit("# "), k), F.concat(F.lit("intro [["), first, F.lit(".md|x]]")), F.lit("- [ ] open [[a]]"), F.lit("  - [x] done"), F.lit("```\n# not a heading\n```"), F.when(F.col("doc_id") % 3 == 0, "### deep").otherwise("## part"), F.lit("  see [[b#c]]")]
    return docs.select(F.concat(F.lit("n-"), k, F.lit(".md")).alias("relative_path"), F.concat(F.lit("---\nuid: x\n---\n"), F.array_join(F.array(*lines), "\n")).alias("content"))


def note_outline(s, d):
    none = F.lit(0)
    return outlines.outline(_outlined(s, d)).select("relative_path", "nth", "kind", F.coalesce("level", none).alias("level"), F.coalesce("parent", none).alias("parent"), "text", "target", F.col("done").cast("string").alias("done"))


def note_view_query(s, d):
    """What the view of each of three ceilings lets a parameterised query count."""
    names = views.register(s, views.flat(project(varied_notes_from_documents(_table(s, d, "documents")))), "quillmark_notes_for_")
    query = "SELECT :who AS ceiling, sensitivity, count(*) AS n FROM {notes} WHERE epistemic_state = :state GROUP BY sensitivity"
    out = [views.ask(s, who, query, names, who=who, state="fact") for who in ("public", "restricted", "secret")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def sketch_estimates(s, d):
    """Whether sketches of each day, merged over all days and by kind, come within 3 % of the exact number of distinct users and properties."""
    e = _table(s, d, "events")
    kept = sketches.daily(e, F.col("ts"), F.col("event_type"), F.concat_ws(":", "user_id", "props"))
    exact = e.groupBy(F.col("event_type").alias("key")).agg(F.count_distinct(F.concat_ws(":", "user_id", "props")).alias("exact"))
    out = sketches.merged(kept, "key").join(exact, "key")
    return out.select("key", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("close"), "exact", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        note_ancestors, note_lineage, note_lineage_diagnostics, varied_variant_fields, varied_variant_paths, note_state_history,
        event_sliding, event_sessions, event_follow_ups, event_asof_view, lineitem_asof_order, event_overlaps,
        note_diagnostics_cube, note_diagnostics_rollup, note_outline, note_view_query, sketch_estimates,
    )
}


def _with_sql() -> dict[str, str]:
    walk = COMPOSED + r"""
        , link AS (
          SELECT DISTINCT relative_path AS source, 'doc-' || unnest(regexp_extract_all(content, '\[\[doc-([0-9]+)\]\]', 1)) || '.md' AS target FROM composed
        ), edge AS (SELECT * FROM link WHERE target IN (SELECT relative_path FROM composed)
        ), step(note, ancestor, depth, way) AS (
          SELECT source, target, 1, [target] FROM edge
          UNION ALL SELECT s.note, e.target, s.depth + 1, list_append(s.way, e.target) FROM step AS s JOIN edge AS e ON e.source = s.ancestor
          WHERE s.ancestor <> s.note AND NOT list_contains(s.way, e.target) AND s.depth < 64
        ), found AS (SELECT note, ancestor, min(depth) AS depth FROM step GROUP BY 1, 2)"""
    walk = walk.replace("WITH composed", "WITH RECURSIVE composed", 1)
    traced = walk + """, per AS (
          SELECT note, count(*) FILTER (ancestor <> note) AS ancestors, max(depth) FILTER (ancestor <> note) AS depth, count(*) FILTER (ancestor <> note AND ancestor NOT IN (SELECT source FROM edge)) AS roots, bool_or(ancestor = note) AS cyclic FROM found GROUP BY 1
        ), traced AS (
          SELECT relative_path, coalesce(ancestors, 0) AS ancestors, coalesce(depth, 0) AS depth, coalesce(roots, 0) AS roots, coalesce(cyclic, false) AS cyclic FROM composed LEFT JOIN per ON note = relative_path)"""
    versions = """
        WITH v AS (SELECT 'user-' || user_id AS key, epoch_us(ts) AS t, event_type AS version, CAST(floor(value / 20) AS INT) AS level FROM events),
        b AS (SELECT *, lag(t) OVER w AS t0, lag(version) OVER w AS v0, lag(level) OVER w AS l0 FROM v WINDOW w AS (PARTITION BY key ORDER BY t, version, level)),
        c AS (SELECT key, t, version, level, CASE WHEN t0 IS NULL OR t >= t0 + 172800000000 THEN 'first' WHEN level > l0 THEN 'raised' WHEN level < l0 THEN 'lowered' WHEN version <> v0 THEN 'edited' END AS event FROM b),
        d AS (SELECT * FROM c WHERE event IS NOT NULL),
        n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t, version, level), epoch_us(TIMESTAMP '2024-01-31')) AS nxt FROM d)"""
    runs = """
        WITH g AS (SELECT user_id, ts, value, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g),
        r AS (SELECT user_id, nth, min(ts) AS a, max(ts) AS b, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM s GROUP BY 1, 2)"""
    known = "known AND authored_sensitivity = '{}'"
    levels = " ".join(f"WHEN {known.format(x)} THEN {n}" for n, x in enumerate(("public", "internal", "restricted", "confidential", "regulated", "phi"), 1))
    found = """
          SELECT 'error' AS severity, 'OKF-FRONTMATTER-001' AS code FROM parsed WHERE has_front_matter AND NOT valid
          UNION ALL SELECT 'warning', 'OKF-SENSITIVITY-001' FROM parsed WHERE authored_sensitivity IS NULL
          UNION ALL SELECT 'error', 'OKF-SENSITIVITY-002' FROM parsed WHERE authored_sensitivity IS NOT NULL AND NOT known
          UNION ALL SELECT 'info', 'OKF-EPISTEMIC-001' FROM parsed WHERE state IS NULL
          UNION ALL SELECT 'error', 'OKF-EPISTEMIC-002' FROM parsed WHERE state IS NOT NULL AND NOT sure
          UNION ALL SELECT 'warning', 'OKF-TEMPORAL-001' FROM parsed WHERE regexp_matches(front, '(created|updated_at): *[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]+\\s') AND valid"""
    flat = r"""
        , both_kinds AS (
          SELECT relative_path, content FROM noted UNION ALL SELECT relative_path, content FROM composed
        ), heads AS (
          SELECT split_part(relative_path, '/', 1) AS top, relative_path LIKE '%/%' AS inner_, regexp_extract(content, '^---[ \t]*\r?\n((?:.*\n)*?)---[ \t]*(?:\r?\n|$)', 0) AS block FROM both_kinds
        ), scalar AS (
          SELECT CASE WHEN inner_ THEN top ELSE '' END AS folder, nullif(regexp_extract(block, '(?:^|\n)sensitivity:[ \t]*["'']?([a-z]+)', 1), '') AS level,
                 nullif(regexp_extract(block, '(?:^|\n)epistemic_state:[ \t]*["'']?([a-z]+)', 1), '') AS state,
                 regexp_extract(block, '(?:^|\n)(?:created_at|created): *["'']?([^"''\n\r]*)', 1) AS created, regexp_extract(block, '(?:^|\n)updated_at: *["'']?([^"''\n\r]*)', 1) AS updated FROM heads
        ), diag AS (
          SELECT folder, 'warning' AS severity, 'OKF-SENSITIVITY-001' AS code FROM scalar WHERE level IS NULL
          UNION ALL SELECT folder, 'error', 'OKF-SENSITIVITY-002' FROM scalar WHERE level NOT IN ('public', 'internal', 'restricted', 'confidential', 'regulated', 'phi', 'secret')
          UNION ALL SELECT folder, 'info', 'OKF-EPISTEMIC-001' FROM scalar WHERE state IS NULL
          UNION ALL SELECT folder, 'error', 'OKF-EPISTEMIC-002' FROM scalar WHERE state NOT IN ('hypothesis', 'fact', 'unknown')
          UNION ALL SELECT folder, 'warning', 'OKF-TEMPORAL-001' FROM (SELECT folder, unnest([created, updated]) AS t FROM scalar) WHERE regexp_matches(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') AND NOT regexp_matches(t, '([Zz]|[+-][0-9]{2}:?[0-9]{2})\s*$')
        )"""
    return {
        "note_ancestors": walk + " SELECT note, ancestor, CAST(depth AS INT) AS depth FROM found",
        "note_lineage": traced + " SELECT relative_path, ancestors, CAST(depth AS INT) AS depth, roots, cyclic FROM traced",
        "note_lineage_diagnostics": traced + " SELECT 'OKF-LINEAGE-001' AS code, 'warning' AS severity, count(*) AS n, min(relative_path) AS first FROM traced WHERE cyclic HAVING count(*) > 0",
        "varied_variant_fields": VARIED + r"""
            SELECT relative_path, valid AS decoded, CAST(confidence AS DOUBLE) AS confidence, nullif(split_part(handling, ',', 1), '') AS first_handling, nullif(split_part(tags, ',', 2), '') AS second_tag,
                   nullif(regexp_extract(front, 'provenance:\s*level: *["'']?([a-z]+)', 1), '') AS provenance_level, nullif(regexp_extract(front, 'okf_version: "([^"]*)"', 1), '') AS version, uid FROM parsed""",
        "varied_variant_paths": VARIED + r"""
            , line AS (
              SELECT relative_path, unnest(string_split(replace(front, chr(13), ''), chr(10))) AS l, generate_subscripts(string_split(replace(front, chr(13), ''), chr(10)), 1) AS i FROM parsed
            ), top AS (
              SELECT relative_path, i, regexp_extract(l, '^([a-z_]+):', 1) AS name, trim(regexp_extract(l, '^[a-z_]+:(.*)$', 1)) AS v FROM line WHERE regexp_matches(l, '^[a-z_]+:')
            ), below AS (
              SELECT t.relative_path, t.name, regexp_extract(l.l, '^  ([a-z_]+):', 1) AS key, trim(regexp_extract(l.l, '^  [a-z_]+:(.*)$', 1)) AS v FROM line AS l JOIN top AS t USING (relative_path)
              WHERE regexp_matches(l.l, '^  [a-z_]+:') AND t.i = (SELECT max(u.i) FROM top AS u WHERE u.relative_path = l.relative_path AND u.i < l.i)
              UNION ALL SELECT relative_path, name, trim(split_part(pair, ':', 1)), trim(split_part(pair, ':', 2)) FROM (SELECT relative_path, name, unnest(regexp_extract_all(v, '[a-z_]+: *(?:\[[^\]]*\]|[^,}]*)')) AS pair FROM top WHERE v LIKE '{%')
            ), kinds AS (
              SELECT '$.' || name AS path, CASE WHEN v = '' OR v LIKE '{%' THEN 'OBJECT' WHEN v LIKE '[%' THEN 'ARRAY' WHEN regexp_full_match(v, '[0-9]+') THEN 'BIGINT' ELSE 'STRING' END AS kind FROM top
              UNION ALL SELECT '$.' || name || '.' || key, CASE WHEN v = '' OR v LIKE '[%' THEN 'ARRAY' WHEN regexp_full_match(v, '[0-9]+\.[0-9]+') THEN 'DECIMAL' WHEN regexp_full_match(v, '[0-9]+') THEN 'BIGINT' ELSE 'STRING' END FROM below
            ) SELECT path, kind, count(*) AS n FROM kinds GROUP BY 1, 2""",
        "note_state_history": versions + """
            SELECT key, event, make_timestamp(t) AS "at", version, level FROM d UNION ALL SELECT key, 'stale', make_timestamp(t + 14400000000), version, level FROM n WHERE t + 14400000000 <= nxt""",
        "event_sliding": """
            WITH w AS (SELECT unnest(range(epoch_us(ts) // 7200000000 - 2, epoch_us(ts) // 7200000000 + 1)) * 7200000000 AS window_start, * FROM events)
            SELECT make_timestamp(window_start) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM w GROUP BY 1, 2""",
        "event_sessions": runs.replace("{gap}", "90 MINUTES") + " SELECT user_id, a AS session_start, b + INTERVAL 90 MINUTES AS session_end, n, total FROM r",
        "event_follow_ups": """
            SELECT a.user_id, a.event_id, coalesce(b.event_id, -1) AS followed_by FROM (SELECT * FROM events WHERE event_type = 'view') AS a
            LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') AS b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS""",
        "event_asof_view": """
            SELECT a.event_id, coalesce(b.event_id, -1) AS last_view_id, b.value AS last_price FROM (SELECT * FROM events WHERE event_type = 'purchase') AS a
            ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS b ON a.user_id = b.user_id AND a.ts >= b.ts""",
        "lineitem_asof_order": """
            WITH l AS (SELECT l_orderkey, l_linenumber, o_custkey AS cust, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT o_custkey AS cust, o_orderdate AS day, max(o_orderkey) AS k FROM orders GROUP BY 1, 2)
            SELECT l_orderkey, l_linenumber, coalesce(k, -1) AS last_order FROM l ASOF LEFT JOIN p ON l.cust = p.cust AND l.l_shipdate >= p.day""",
        "event_overlaps": runs.replace("{gap}", "5 HOURS") + """
            , q AS (SELECT user_id, event_id, ts AS c, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events WHERE event_type = 'error')
            SELECT r.user_id, a AS run_start, count(*) AS n, min(event_id) AS first FROM r JOIN q ON r.user_id = q.user_id AND a <= d AND c <= b GROUP BY r.user_id, a""",
        "note_diagnostics_cube": VARIED.rstrip() + COMPOSED.replace("WITH composed", ", composed", 1) + flat + " SELECT severity, code, folder, CAST(grouping(severity, code, folder) AS BIGINT) AS grouping, count(*) AS n FROM diag GROUP BY CUBE (severity, code, folder)",
        "note_diagnostics_rollup": VARIED + f"SELECT severity, code, folder, CAST(grouping(severity, code, folder) AS BIGINT) AS grouping, count(*) AS n FROM (SELECT severity, code, 'varied' AS folder FROM ({found})) GROUP BY ROLLUP (severity, code, folder)",
        "note_outline": r"""
            WITH t AS (SELECT doc_id, 'n-' || doc_id || '.md' AS p, regexp_extract(coalesce("text", ''), '[A-Za-z]+', 0) AS w FROM documents),
            u AS (SELECT *, w || '.md|x' AS shown, (w <> '')::INT AS has FROM t)
            SELECT p AS relative_path, 1 AS nth, 'heading' AS kind, 1 AS level, 0 AS parent, doc_id::VARCHAR AS text, NULL::VARCHAR AS target, NULL::VARCHAR AS done FROM u
            UNION ALL SELECT p, 2, 'link', 0, 1, shown, lower(w), NULL FROM u
            UNION ALL SELECT p, 3, 'task', 1, 1, 'open [[a]]', NULL, 'false' FROM u
            UNION ALL SELECT p, 4, 'link', 0, 3, 'a', 'a', NULL FROM u
            UNION ALL SELECT p, 5, 'task', 2, 3, 'done', NULL, 'true' FROM u
            UNION ALL SELECT p, 6, 'heading', CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END, 1, CASE WHEN doc_id % 3 = 0 THEN 'deep' ELSE 'part' END, NULL, NULL FROM u
            UNION ALL SELECT p, 7, 'link', 0, 6, 'b#c', 'b', NULL FROM u""",
        "note_view_query": VARIED + f"""
            , seen AS (SELECT CASE {levels} ELSE 7 END AS rank, CASE WHEN known THEN authored_sensitivity ELSE 'secret' END AS sensitivity FROM parsed WHERE sure AND state = 'fact')
            SELECT ceiling, sensitivity, count(*) AS n FROM seen JOIN (VALUES ('public', 1), ('restricted', 3), ('secret', 7)) AS c(ceiling, top) ON rank <= top GROUP BY 1, 2""",
        "sketch_estimates": "SELECT event_type AS key, true AS close, count(DISTINCT concat_ws(':', user_id, props)) AS exact, count(*) AS n FROM events GROUP BY 1",
    }


ORACLE_SQL: dict[str, str] = _with_sql()
