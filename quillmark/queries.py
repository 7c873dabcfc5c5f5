"""The registered queries over the note operators, each beside SQL that reaches the same rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark import extended_queries
from quillmark.composed_sql import READ, VARIED
from quillmark.functions import text
from quillmark.operators import assess, graph, proposals, settings, validate
from quillmark.operators.projection import Options, project, reason, visible
from quillmark.sources.notes import notes_from_documents, varied_notes_from_documents
from quillmark.streaming.watch import event_windows

FLAT = Options(flat=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_from_documents(_table(spark, sf_dir, "documents"))


def _by_reason(p: DataFrame) -> DataFrame:
    return p.groupBy(F.col("effective.sensitivity").alias("effective"), reason(p).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def note_effective_sensitivity(s, d):
    return _by_reason(project(_notes(s, d), FLAT))


def note_sensitivity_relaxed_default(s, d):
    return _by_reason(project(_notes(s, d), Options("internal", flat=True)))


def note_epistemic(s, d):
    p = project(_notes(s, d), FLAT)
    return p.groupBy(F.col("effective.epistemic_state").alias("state"), F.col("effective.epistemic_state_defaulted").alias("defaulted")).agg(F.count(F.lit(1)).alias("n"))


def note_diagnostics(s, d):
    return validate.summary(project(_notes(s, d), FLAT))


def note_severity_gate(s, d):
    return validate.gate(project(_notes(s, d), FLAT))


def note_temporal(s, d):
    p = project(_notes(s, d), FLAT)
    return p.where(F.size(validate.with_prefix(F.col("diagnostics"), "OKF-TEMPORAL")) > 0).select("relative_path")


def note_duplicate_uid(s, d):
    return validate.duplicate_identities(project(_notes(s, d), FLAT))


def note_ceiling_filter(s, d):
    p = visible(project(_notes(s, d), FLAT), "confidential")
    return p.select("relative_path", F.col("effective.sensitivity").alias("sensitivity"))


def note_raise_only(s, d):
    p = project(_notes(s, d), FLAT).withColumn("doc_id", F.regexp_extract("relative_path", r"(\d+)", 1).cast("long"))
    asked = _table(s, d, "labels").where("toxic = 1").select("doc_id", F.lit("restricted").alias("proposed"))
    out = p.join(asked, "doc_id")
    return out.select("doc_id", text.raise_only(F.col("effective.sensitivity"), F.col("proposed")).alias("raised"))


def note_build(s, d):
    out = assess.build_block(_notes(s, d), Options("internal"), "0")
    return out.select("engine_version", "policy_hash", "corpus_hash", "notes")


def note_graph_document(s, d):
    """The graph document's parts as they are written."""
    out = graph.graph_json(project(_notes(s, d), FLAT))
    return out.select("kind", F.translate("key", "\u0000", "|").alias("key"), "json")


def proposal_sink(s, d):
    """What is printed of each answered request."""
    out = proposals.document(proposals.check(*_answers(s, d)))
    return out.select("request_id", F.get_json_object("json", "$.authoritative").alias("authoritative"), F.get_json_object("json", "$.proposals[0].proposalId").alias("proposal_id"), F.get_json_object("json", "$.warnings").alias("warnings"))


def note_links(s, d):
    n = _notes(s, d)
    return graph.resolve(graph.links(n), n)


def note_graph_stats(s, d):
    return graph.stats(_notes(s, d))


def note_dangling(s, d):
    n = _notes(s, d)
    return graph.dangling(graph.links(n), n)


def note_assessment(s, d):
    return assess.assess(project(_notes(s, d), FLAT))


def episode_export(s, d):
    return assess.episodes(project(_notes(s, d), FLAT), "corpus")


def page_links(s, d):
    return graph.page_links(_table(s, d, "pages")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


def duplicate_content(s, d):
    return assess.duplicate_content(_table(s, d, "documents"), "doc_id", "text")


def corpus_hash(s, d):
    return assess.corpus_hash(_table(s, d, "documents"), "doc_id", "text")


def varied_projection(s, d):
    """Every composed form of front matter through the YAML decoder, a row a note."""
    p = project(varied_notes_from_documents(_table(s, d, "documents")))
    a, e = F.col("authored"), F.col("effective")
    return p.select("relative_path", "has_front_matter", "front_matter_valid", a["uid"].alias("uid"), a["sensitivity"].alias("authored_sensitivity"), F.array_join(a["handling"], ",").alias("handling"), F.array_join(a["tags"], ",").alias("tags"), a["confidence"].alias("confidence"), e["sensitivity"].alias("sensitivity"), e["epistemic_state"].alias("epistemic_state"), e["epistemic_state_defaulted"].alias("epistemic_state_defaulted"))


def varied_diagnostics(s, d):
    return validate.summary(project(varied_notes_from_documents(_table(s, d, "documents"))))


def varied_ceiling_filter(s, d):
    p = visible(project(varied_notes_from_documents(_table(s, d, "documents")), Options("internal")), "restricted")
    return p.select("relative_path", F.col("effective.sensitivity").alias("sensitivity"))


def varied_flat_projection(s, d):
    """The same notes through the flat decoder, which reads scalar lines only."""
    p = project(varied_notes_from_documents(_table(s, d, "documents")), FLAT)
    return p.select("relative_path", F.col("authored.uid").alias("uid"), F.col("authored.sensitivity").alias("authored_sensitivity"), F.col("effective.sensitivity").alias("sensitivity"))


def task_alias(s, d):
    names = F.array(*map(F.lit, ("explain", "improve", "repair", "find-links", "find-claims", "check-conflicts", "check-privacy")))
    e = _table(s, d, "events")
    name = F.when(F.col("event_id") % 9 < 7, F.try_element_at(names, (F.col("event_id") % 9 + 1).cast("int"))).otherwise(F.col("event_type"))
    return e.select("event_id", name.alias("name"), text.resolve_task(name).alias("task"))


def loopback_filter(s, d):
    hosts = F.array(*map(F.lit, ("http://127.0.0.1:8765", "http://localhost", "http://[::1]:9", "http://127.0.0.1.example.com", "http://localhost.example.com:80")))
    pages = _table(s, d, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)?$", 1)
    local = F.concat(F.element_at(hosts, (F.col("page_id") % 5 + 1).cast("int")), path)
    urls = pages.select("page_id", F.col("url")).unionByName(pages.select("page_id", local.alias("url")))
    return urls.where(text.is_loopback(F.col("url")))


def query_encode(s, d):
    return _table(s, d, "pages").select("page_id", text.encode_query(F.col("url")).alias("encoded"))


def settings_normalize(s, d):
    e = _table(s, d, "events")
    levels = F.element_at(F.array(*map(F.lit, ("public", "phi", "nonsense", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"notes_dir":"'), F.when(F.col("event_id") % 3 == 0, "/notes").otherwise(""), F.lit('","default_sensitivity":"'), levels, F.lit('","port":'), (F.col("event_id") * 97 - 500).cast("string"), F.lit(',"enabled":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise('"yes"'), F.lit("}"))
    out = e.select("event_id", settings.normalize(body).alias("s"))
    return out.select("event_id", "s.*", settings.blocked_reason(F.col("s")).alias("blocked"))


def _lockfiles(s, d):
    """A lockfile for each part: a pinned, a branch, a bare and a registry dependency, by its key."""
    p = _table(s, d, "part")
    k = F.col("p_partkey").cast("string")
    commit = F.sha1("p_name")
    ref = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), commit)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("#v"), k)).otherwise("")
    entry = F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("https://h/"), k, F.lit(".tgz"))).otherwise(F.concat(F.lit("git+https://h/"), k, F.lit(".git"), ref))
    body = F.concat(F.lit('{"packages":{"":{"version":"1"},"dep-'), k, F.lit('":{"resolved":"'), entry, F.lit('"},"other":{"resolved":"git+ssh://h/o.git#'), commit, F.lit('"}}}'))
    return p.select("p_partkey", body.alias("content"))


def lockfile_pins(s, d):
    return settings.git_pins(_lockfiles(s, d)).groupBy("name", "resolved", "ref", "pinned").agg(F.count(F.lit(1)).alias("n"))


def lockfile_problems(s, d):
    out = settings.pin_problems(_lockfiles(s, d))
    return out.select("git_dependencies", F.size("problems").cast("long").alias("problems"), F.element_at("problems", 1).alias("first_problem"))


def _answers(s, d):
    """A response made up for each labelled document; every fifth claims authority, every seventh is for another note."""
    ids = _table(s, d, "labels").select("doc_id")
    k = F.col("doc_id").cast("string")
    request = F.concat(F.lit("request:"), k)
    target = F.when(F.col("doc_id") % 7 == 0, "elsewhere.md").otherwise(F.concat(F.lit("doc-"), k, F.lit(".md")))
    patch = F.when(F.col("doc_id") % 5 == 0, ',"proposedPatch":{"approved":true}').otherwise("")
    body = F.concat(F.lit('{"contractVersion":"1.0","requestId":"'), request, F.lit('","proposals":[{"contractVersion":"1.0","proposalId":"p'), k, F.lit('","proposalType":"relationship","targetId":"'), target, F.lit('","confidence":0.5'), patch, F.lit("}]}"))
    asked = ids.select(request.alias("request_id"), F.lit("relationship").alias("task"), F.concat(F.lit("doc-"), k, F.lit(".md")).alias("target_id"))
    return ids.select(request.alias("request_id"), body.alias("body")), asked


def proposal_outcomes(s, d):
    return proposals.outcome(proposals.check(*_answers(s, d)))


def generic_event_windows(s, d):
    out = event_windows(_table(s, d, "events").withColumn("value", F.col("value").cast("decimal(18,4)")), "1 day")
    return out.select("window_start", "event_type", "n", F.col("total").cast("double").alias("total"))


def generic_pricing_summary(s, d):
    money = "decimal(18,4)"
    li = _table(s, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    out = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast(money)).alias("q"), F.sum(F.col("l_extendedprice").cast(money)).alias("p"), F.count(F.lit(1)).alias("n"))
    return out.select("l_returnflag", "l_linestatus", F.col("q").cast("double").alias("sum_qty"), F.col("p").cast("double").alias("sum_price"), "n")


def generic_customer_rank(s, d):
    o = _table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = _table(s, d, "customer").select("c_custkey", "c_mktsegment")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "c_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("c_mktsegment", "c_custkey", "n", F.col("rank").cast("long").alias("rank"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        note_effective_sensitivity, note_sensitivity_relaxed_default, note_epistemic, note_diagnostics, note_severity_gate, note_temporal, note_duplicate_uid, note_ceiling_filter, note_raise_only,
        varied_projection, varied_diagnostics, varied_ceiling_filter, varied_flat_projection,
        note_links, note_graph_stats, note_graph_document, note_build, note_dangling, note_assessment, episode_export, page_links, duplicate_content, corpus_hash, task_alias, loopback_filter, query_encode, settings_normalize,
        lockfile_pins, lockfile_problems, proposal_outcomes, proposal_sink, generic_event_windows, generic_pricing_summary, generic_customer_rank,
    )
}

#: Of the notes that were read back from composed text.
_REASON = "CASE WHEN authored IS NULL THEN 'missing' WHEN place = 0 THEN 'invalid' ELSE 'ok' END"
_FOUND = """
          SELECT 'warning' AS severity, 'OKF-SENSITIVITY-001' AS code FROM read WHERE authored IS NULL
          UNION ALL SELECT 'error', 'OKF-SENSITIVITY-002' FROM read WHERE authored IS NOT NULL AND place = 0
          UNION ALL SELECT 'info', 'OKF-EPISTEMIC-001' FROM read WHERE state IS NULL
          UNION ALL SELECT 'error', 'OKF-EPISTEMIC-002' FROM read WHERE state IS NOT NULL AND NOT sure
          UNION ALL SELECT 'warning', 'OKF-TEMPORAL-001' FROM read WHERE naive"""
_TREE = """
        inner_ AS (SELECT substr(md5(p), 1, 4) AS bucket, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p || ':' || h)) AS b, count(*) AS n FROM one GROUP BY 1),
        tree AS (SELECT sha256(string_agg(bucket || ':' || b, chr(10) ORDER BY bucket || ':' || b)) AS corpus_hash, CAST(sum(n) AS BIGINT) AS notes FROM inner_)"""
_LOCKS = r"""
        WITH files AS (
          SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN 'https://h/' || p_partkey || '.tgz' ELSE 'git+https://h/' || p_partkey || '.git' || CASE p_partkey % 3 WHEN 0 THEN '#' || sha1(p_name) WHEN 1 THEN '#v' || p_partkey ELSE '' END END AS a,
                 'git+ssh://h/o.git#' || sha1(p_name) AS b FROM part
        ), pins AS (
          SELECT name, resolved, CASE WHEN strpos(resolved, '#') > 0 THEN substr(resolved, strpos(resolved, '#') + 1) ELSE '' END AS ref
          FROM (SELECT 'dep-' || k AS name, a AS resolved FROM files UNION ALL SELECT 'other', b FROM files) WHERE resolved LIKE 'git+%'
        )
        """

ORACLE_SQL: dict[str, str] = {
    "note_effective_sensitivity": READ + f"SELECT effective, {_REASON} AS reason, count(*) AS n FROM read GROUP BY 1, 2",
    "note_sensitivity_relaxed_default": READ + f"SELECT CASE WHEN authored IS NULL THEN 'internal' ELSE effective END AS effective, {_REASON} AS reason, count(*) AS n FROM read GROUP BY 1, 2",
    "note_epistemic": READ + "SELECT CASE WHEN sure THEN state ELSE 'unknown' END AS state, NOT sure AS defaulted, count(*) AS n FROM read GROUP BY 1, 2",
    "note_diagnostics": READ + f"SELECT severity, code, count(*) AS n FROM ({_FOUND}) GROUP BY 1, 2",
    "note_severity_gate": READ + f"SELECT (SELECT count(*) FROM read) AS notes, count(*) AS failures, CAST(count(*) > 0 AS INT) AS exit_code FROM ({_FOUND}) WHERE severity IN ('error', 'critical')",
    "note_temporal": READ + "SELECT relative_path FROM read WHERE naive",
    "note_duplicate_uid": READ + "SELECT uid, count(*) AS n, min(relative_path) AS first_path, 'OKF-IDENTITY-001' AS code FROM read WHERE uid IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "note_ceiling_filter": READ + "SELECT relative_path, effective AS sensitivity FROM read WHERE place BETWEEN 1 AND 4",
    "note_raise_only": READ + "SELECT doc_id, CASE WHEN place BETWEEN 1 AND 2 THEN 'restricted' ELSE effective END AS raised FROM read JOIN labels ON relative_path = 'doc-' || doc_id || '.md' WHERE toxic = 1",
    "note_links": READ + "SELECT a.relative_path AS source_path, a.link AS target_raw, b.relative_path AS target_path, 'link' AS link_type FROM read AS a LEFT JOIN read AS b ON b.relative_path = a.link || '.md'",
    "note_graph_stats": READ + "SELECT count(*) AS notes, count(link) AS links, count(link) FILTER (link || '.md' IN (SELECT relative_path FROM read)) AS resolved, count(DISTINCT link) AS targets FROM read",
    "note_build": READ + f"""
        , one AS (SELECT relative_path AS p, sha256(content) AS h FROM read), {_TREE}
        SELECT '0' AS engine_version, sha256('{{"default_sensitivity": "internal"}}') AS policy_hash, corpus_hash, notes FROM tree""",
    "note_graph_document": READ + """
        , loose AS (SELECT DISTINCT relative_path, link FROM read WHERE link IS NOT NULL AND link || '.md' NOT IN (SELECT relative_path FROM read)), same AS (SELECT uid, min(relative_path) AS first_path FROM read WHERE uid IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        SELECT 'node' AS kind, relative_path AS key, '{' || CASE WHEN state IS NOT NULL THEN '"authoredEpistemicState":"' || state || '",' ELSE '' END || '"epistemicState":"' || CASE WHEN sure THEN state ELSE 'unknown' END || '","id":"' || relative_path
               || '","sensitivity":"' || effective || '","tags":[]' || CASE WHEN title IS NOT NULL THEN ',"title":"' || title || '"' ELSE '' END || ',"uid":"' || uid || '"}' AS json FROM read
        UNION ALL SELECT 'link', relative_path || '|' || link, '{"link_type":"link","source_path":"' || relative_path || '"' || CASE WHEN link || '.md' IN (SELECT relative_path FROM read) THEN ',"target_path":"' || link || '.md"' ELSE '' END || ',"target_raw":"' || link || '"}' FROM read WHERE link IS NOT NULL
        UNION ALL SELECT 'stats', '', '{"links":' || count(link) || ',"notes":' || count(*) || ',"resolved":' || count(link) FILTER (link || '.md' IN (SELECT relative_path FROM read)) || ',"targets":' || count(DISTINCT link) || '}' FROM read
        UNION ALL SELECT 'diagnostic', 'OKF-LINK-001|' || relative_path || '|link to no note: ' || link, '{"code":"OKF-LINK-001","message":"link to no note: ' || link || '","severity":"warning","subject":"' || relative_path || '"}' FROM loose
        UNION ALL SELECT 'diagnostic', 'OKF-IDENTITY-001|' || first_path || '|several notes have the uid ' || uid, '{"code":"OKF-IDENTITY-001","message":"several notes have the uid ' || uid || '","severity":"error","subject":"' || first_path || '"}' FROM same""",
    "note_dangling": READ + "SELECT relative_path AS source_path, link AS target_raw FROM read WHERE link IS NOT NULL AND link || '.md' NOT IN (SELECT relative_path FROM read)",
    "note_assessment": READ + """
        SELECT relative_path, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS label FROM (
          SELECT relative_path, CAST(25 * (uid IS NOT NULL)::INT + 20 * (title IS NOT NULL)::INT + 20 * (created IS NOT NULL AND NOT naive)::INT + 20 * (place > 0)::INT + 15 * sure::INT AS INT) AS score FROM read)""",
    "episode_export": READ + "SELECT coalesce(uid, relative_path) AS uid, coalesce(title, relative_path) AS name, relative_path AS source, effective AS sensitivity, 'corpus' AS group_id FROM read",
    "page_links": """SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""",
    "duplicate_content": "SELECT sha256(coalesce(text, '')) AS content_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "corpus_hash": f"WITH one AS (SELECT CAST(doc_id AS VARCHAR) AS p, sha256(coalesce(text, '')) AS h FROM documents), {_TREE} SELECT corpus_hash, notes FROM tree",
    "varied_projection": VARIED + """
        SELECT relative_path, has_front_matter, valid AS front_matter_valid, uid, authored_sensitivity, CASE WHEN valid OR NOT has_front_matter THEN handling END AS handling, CASE WHEN valid OR NOT has_front_matter THEN tags END AS tags, confidence,
               CASE WHEN known THEN authored_sensitivity ELSE 'secret' END AS sensitivity, CASE WHEN sure THEN state ELSE 'unknown' END AS epistemic_state, NOT sure AS epistemic_state_defaulted FROM parsed""",
    "varied_diagnostics": VARIED + """
        SELECT severity, code, count(*) AS n FROM (
          SELECT 'error' AS severity, 'OKF-FRONTMATTER-001' AS code FROM parsed WHERE has_front_matter AND NOT valid
          UNION ALL SELECT 'warning', 'OKF-SENSITIVITY-001' FROM parsed WHERE authored_sensitivity IS NULL
          UNION ALL SELECT 'error', 'OKF-SENSITIVITY-002' FROM parsed WHERE authored_sensitivity IS NOT NULL AND NOT known
          UNION ALL SELECT 'info', 'OKF-EPISTEMIC-001' FROM parsed WHERE state IS NULL
          UNION ALL SELECT 'error', 'OKF-EPISTEMIC-002' FROM parsed WHERE state IS NOT NULL AND NOT sure
          UNION ALL SELECT 'warning', 'OKF-TEMPORAL-001' FROM parsed WHERE regexp_matches(front, '(created|updated_at): *[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]+\\s') AND valid
        ) GROUP BY 1, 2""",
    "varied_ceiling_filter": VARIED + """
        SELECT relative_path, level AS sensitivity FROM (SELECT relative_path, CASE WHEN known THEN authored_sensitivity WHEN authored_sensitivity IS NULL THEN 'internal' ELSE 'secret' END AS level FROM parsed)
        WHERE level IN ('public', 'internal', 'restricted')""",
    "varied_flat_projection": VARIED + """
        SELECT relative_path, nullif(regexp_extract(block, '(?:^|\\n)uid: *["'']?([0-9]+)', 1), '') AS uid, flat AS authored_sensitivity,
               CASE WHEN flat IN ('public', 'internal', 'restricted', 'confidential', 'regulated', 'phi', 'secret') THEN flat ELSE 'secret' END AS sensitivity
        FROM (SELECT *, nullif(regexp_extract(block, '\\nsensitivity: *["'']?([a-z]+)', 1), '') AS flat FROM parsed)""",
    "task_alias": """
        SELECT event_id, name, coalesce(task, name) AS task FROM (
          SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'explain' WHEN 1 THEN 'improve' WHEN 2 THEN 'repair' WHEN 3 THEN 'find-links' WHEN 4 THEN 'find-claims' WHEN 5 THEN 'check-conflicts' WHEN 6 THEN 'check-privacy' ELSE event_type END AS name FROM events)
        LEFT JOIN (VALUES ('explain', 'diagnostic_explanation'), ('improve', 'documentation_improvement'), ('repair', 'metadata_repair'), ('find-links', 'relationship'),
          ('find-claims', 'claim_extraction'), ('check-conflicts', 'contradiction'), ('check-privacy', 'classification_raise')) AS t(alias, task) ON name = alias""",
    "loopback_filter": r"""
        SELECT page_id, url FROM (
          SELECT page_id, url FROM pages
          UNION ALL SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://127.0.0.1:8765' WHEN 1 THEN 'http://localhost' WHEN 2 THEN 'http://[::1]:9' WHEN 3 THEN 'http://127.0.0.1.example.com' ELSE 'http://localhost.example.com:80' END
                 || regexp_extract(url, '^[a-z]+://[^/]*(/.*)?$', 1) FROM pages)
        WHERE regexp_matches(url, '^[a-z]+://(127\.0\.0\.1|localhost|\[::1\])(:[0-9]+)?(/|$)')""",
    "query_encode": "SELECT page_id, url_encode(url) AS encoded FROM pages",
    "settings_normalize": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '/notes' END AS notes_dir, CASE event_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'phi' ELSE 'secret' END AS default_sensitivity,
               CAST(CASE WHEN event_id * 97 - 500 BETWEEN 1 AND 65535 THEN event_id * 97 - 500 ELSE 4814 END AS INT) AS port, event_id % 2 = 0 AS enabled, false AS wizard_completed,
               CASE WHEN event_id % 3 <> 0 THEN 'notes_dir is not set' END AS blocked FROM events""",
    "lockfile_pins": _LOCKS + "SELECT name, resolved, ref, regexp_full_match(ref, '[0-9a-f]{40}') AS pinned, count(*) AS n FROM pins GROUP BY ALL",
    "lockfile_problems": _LOCKS + """
        SELECT count(*) AS git_dependencies, count(problem) AS problems, min(problem) AS first_problem FROM (
          SELECT CASE WHEN ref = '' THEN name || ': no ref' WHEN NOT regexp_full_match(ref, '[0-9a-f]{40}') THEN name || ': ' || ref END AS problem FROM pins)""",
    "proposal_outcomes": """
        SELECT 'request:' || doc_id AS request_id, CAST((doc_id % 7 <> 0 AND doc_id % 5 <> 0)::INT AS BIGINT) AS proposals,
               CASE WHEN doc_id % 7 = 0 THEN 'PROPOSAL: proposal is for another note' WHEN doc_id % 5 = 0 THEN 'PROPOSAL: patch claims authority' END AS warnings,
               CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, false AS authoritative FROM labels""",
    "proposal_sink": """
        SELECT 'request:' || doc_id AS request_id, 'false' AS authoritative, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'p' || doc_id END AS proposal_id,
               CASE WHEN doc_id % 7 = 0 THEN 'PROPOSAL: proposal is for another note' WHEN doc_id % 5 = 0 THEN 'PROPOSAL: patch claims authority' END AS warnings FROM labels""",
    "generic_event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "generic_pricing_summary": """
        SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "generic_customer_rank": """
        SELECT c_mktsegment, c_custkey, n, rank FROM (
          SELECT c_mktsegment, c_custkey, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_custkey) AS rank
          FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey) WHERE rank <= 10""",
}

QUERIES |= extended_queries.QUERIES
ORACLE_SQL |= extended_queries.ORACLE_SQL
