"""The notes that queries compose from ``documents``, as SQL text: composed once more, then read by patterns only."""

from __future__ import annotations

from quillmark.sources.notes import FORMS
from quillmark.vocabulary import SENSITIVITY


def _varied() -> str:
    """The composed notes as text, and what patterns find in that text; the forms' rule is not used beyond composing."""
    case = " ".join(f"WHEN {n} THEN '{x.replace('{{', '{').replace('}}', '}').replace(chr(39), chr(39) * 2)}'" for n, x in enumerate(FORMS))
    levels = " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate((*SENSITIVITY, "unclassified")))
    return f"""
        WITH noted AS (
          SELECT 'varied/' || doc_id || '.md' AS relative_path, replace(replace(replace(replace(CASE doc_id % 8 {case} END, '{{id}}', doc_id::VARCHAR), '{{level}}', CASE doc_id // 8 % 8 {levels} END),
                 '{{state}}', CASE doc_id // 4 % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'hypothesis' ELSE 'gospel' END), '{{day}}', lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')) || coalesce(text, '') AS content FROM documents
        ), split AS (
          SELECT *, regexp_extract(content, '^---\\r?\\n((?:[^-\\r\\n][^\\r\\n]*\\r?\\n)*)---\\r?\\n', 1) AS block FROM noted
        ), found AS (
          SELECT *, block <> '' AS has_front_matter, block <> '' AND NOT regexp_matches(block, '\\[[^\\]]*$') AS valid FROM split
        ), picked AS (
          SELECT *, CASE WHEN valid THEN block ELSE '' END AS front FROM found
        ), parsed AS (
          SELECT *, nullif(regexp_extract(front, '(?:^|\\n)uid: *["'']?([0-9]+)', 1), '') AS uid,
                 nullif(regexp_extract(front, '(?:^|\\n)sensitivity:(?:\\s*\\{{?\\s*level:)? *["'']?([a-z]+)', 1), '') AS authored_sensitivity,
                 nullif(regexp_extract(front, '(?:^|\\n)epistemic(?:_state)?:(?:\\s*\\{{?\\s*state:)? *["'']?([a-z]+)', 1), '') AS state,
                 nullif(regexp_extract(front, 'confidence: *([0-9.]+)', 1), '') AS confidence,
                 CASE WHEN front LIKE '%handling: [keep, local]%' THEN 'keep,local' WHEN front LIKE '%- "keep"%' THEN 'keep' ELSE '' END AS handling,
                 replace(regexp_extract(front, 'tags: \\[([^\\]]*)\\]', 1), ' ', '') AS tags,
                 coalesce(authored_sensitivity IN ('public', 'internal', 'restricted', 'confidential', 'regulated', 'phi', 'secret'), false) AS known, coalesce(state IN ('hypothesis', 'fact', 'unknown'), false) AS sure
          FROM picked
        )"""


def _composed() -> str:
    """The notes of ``notes_from_documents`` as text (``composed``), and the fields that patterns find in their front matter (``read``)."""
    labels = " ".join(f"WHEN {n} THEN 'sensitivity: \"{x}\"' || chr(10)" for n, x in enumerate(SENSITIVITY))
    return rf"""
        WITH composed AS (
          SELECT 'doc-' || doc_id || '.md' AS relative_path, '---' || chr(10) || 'uid: "' || (doc_id - (doc_id % 50 = 49)::INT) || '"' || chr(10)
                 || CASE doc_id % 9 {labels} WHEN 7 THEN '' ELSE 'sensitivity: "unclassified"' || chr(10) END
                 || CASE WHEN doc_id % 4 <> 0 THEN 'title: "Note ' || doc_id || '"' || chr(10) ELSE '' END
                 || CASE doc_id % 4 WHEN 3 THEN '' ELSE 'epistemic_state: "' || CASE doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'hypothesis' ELSE 'gospel' END || '"' || chr(10) END
                 || CASE doc_id % 3 WHEN 0 THEN 'created_at: "2026-01-01T00:00:00Z"' || chr(10) WHEN 1 THEN 'created_at: 2026-01-01 00:00:00' || chr(10) ELSE '' END
                 || '---' || chr(10) || coalesce("text", '') || chr(10) || '[[doc-' || (doc_id * 7 % 1200) || ']]' AS content FROM documents
        )"""


_READ = r"""
        , front AS (
          SELECT *, regexp_extract(content, '^---[ \t]*\r?\n((?:.*\n)*?)---[ \t]*(?:\r?\n|$)', 1) AS block FROM composed
        ), picked AS (
          SELECT relative_path, content, nullif(regexp_extract(block, '(?:^|\n)uid: "([^"\n]*)"', 1), '') AS uid, nullif(regexp_extract(block, '(?:^|\n)title: "([^"\n]*)"', 1), '') AS title,
                 nullif(regexp_extract(block, '(?:^|\n)sensitivity: "([^"\n]*)"', 1), '') AS authored, nullif(regexp_extract(block, '(?:^|\n)epistemic_state: "([^"\n]*)"', 1), '') AS state,
                 nullif(regexp_extract(block, '(?:^|\n)created_at: *"?([^"\n]*)', 1), '') AS created, nullif(regexp_extract(content, '\[\[([^\[\]\r\n]+)\]\]\s*$', 1), '') AS link FROM front
        ), read AS (
          SELECT *, coalesce(list_position(['public', 'internal', 'restricted', 'confidential', 'regulated', 'phi', 'secret'], authored), 0) AS place, coalesce(state IN ('hypothesis', 'fact', 'unknown'), false) AS sure,
                 coalesce(regexp_matches(created, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') AND NOT regexp_matches(created, '([Zz]|[+-][0-9]{2}:?[0-9]{2})\s*$'), false) AS naive,
                 CASE WHEN place > 0 THEN authored ELSE 'secret' END AS effective FROM picked
        )"""

COMPOSED = _composed()
READ = COMPOSED + _READ
VARIED = _varied()
