"""Queries over the pieces that reports are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed, sinks
from ..operators import findings as G
from ..operators.scan import hits_in_order
from ..schema import FILE_FINDING_COLUMNS, HIT_COLUMNS
from . import views as V
from .register import query
from .registry import _ALIAS_SQL, _COVER, _EVENT_CTX, _EVIDENCE, _ITEM_SQL, _PACK, _SEV, _event_coverage, _event_hits

_NUMBERED = f"{_EVENT_CTX}, n AS (SELECT *, row_number() OVER (ORDER BY artifact_path, line_number, rule_ord) AS no, CASE product WHEN {V._q(fixed.PRODUCT)} THEN {V._q(fixed.CAUTION_HIT)} ELSE {V._q(fixed.CAUTION_GENERIC)} END AS caution, CASE product WHEN {V._q(fixed.PRODUCT)} THEN {V._q(fixed.STATUS_HIT)} ELSE {V._q(fixed.STATUS_GENERIC)} END AS status FROM hits)"
_AT = "CAST(line_number AS VARCHAR)"
_ESCAPED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def _e(column: str) -> str:
    for c, said in _ESCAPED:
        column = f"replace({column}, {V._q(c)}, {V._q(said)})"
    return column


def _text_sql() -> str:
    why = "'Pattern matched text ''' || matched_text || '''.'"
    values = ["rule_id", "severity", "issue_category", "component", "artifact_path", _AT, "''", "raw_line", "context_before", "context_after", "kb_candidate_ids", why, "caution", "status"]
    return " || chr(10) || ".join(f"'{' ' if k else '-'} {label}: ' || {v}" for k, (label, v) in enumerate(zip(fixed.LABELS_TEXT, values, strict=True))) + " || chr(10)"


def _html_sql() -> str:
    why = "'Pattern matched text ' || matched_text || '.'"
    values = ["rule_id", "severity", "issue_category", "component", "artifact_path", _AT, "''", "kb_candidate_ids", why, "caution", "status"]
    told = " || '<br>' || ".join(f"'<strong>{label}:</strong> ' || {_e(v)}" for label, v in zip(fixed.LABELS_HTML, values, strict=True))
    lines = " || chr(10) || ".join(f"'{c}: ' || {_e(c)}" for c in ("raw_line", "context_before", "context_after"))
    return f"'<div class=''hit''><p>' || {told} || '</p><pre>' || {lines} || '</pre></div>' || chr(10)"


_SECTION = f"CAST({sinks.FIRST_SEVERITY} + list_position([{', '.join(map(V._q, fixed.SEVERITIES))}], severity) - 1 AS INT)"
_SHORT = f"'- ' || rule_id || ' ' || artifact_path || ':' || {_AT} || ' ' || raw_line || chr(10)"
_PIECES = f"""{_NUMBERED}
SELECT 'text' AS report, {_SECTION} AS section, no, md5({_text_sql()}) AS digest FROM n UNION ALL SELECT 'html', {_SECTION}, no, md5({_html_sql()}) FROM n
UNION ALL SELECT 'text', CAST({sinks.APPENDIX} AS INT), no, md5({_SHORT}) FROM n UNION ALL SELECT 'html', CAST({sinks.APPENDIX} AS INT), no, md5({_html_sql()}) FROM n"""


def _numbered_hits(spark, sf_dir):
    return hits_in_order(V.event_lines(spark, sf_dir), _PACK)


@query("report_pieces", _PIECES)
def report_pieces(spark, sf_dir):
    """What both reports say of every hit, with its section and place: severity sections and appendix, from one pass over the hits."""
    said = sinks.hit_lines(_numbered_hits(spark, sf_dir))
    return said.select("report", "section", "no", F.md5("text").alias("digest"))


_RECORD = {"hit_id": "printf('H%06d', no)", "line_number": _AT, "byte_offset": "''", "timestamp": "''", "match_type": "'text-line'", "scanner": "'text-line-scanner'", "encoding": "'utf-8'"}


def _record_sql(columns, own) -> str:
    return " || ',' || ".join("'\"' || replace(" + own.get(c, f"CAST({c} AS VARCHAR)") + ", '\"', '\"\"') || '\"'" for c in columns)


@query("all_hits_csv", f"{_NUMBERED} SELECT no, {_record_sql(HIT_COLUMNS, _RECORD)} AS record FROM n")
def all_hits_csv(spark, sf_dir):
    """Every hit as a CSV record with its place in the file."""
    hits = _numbered_hits(spark, sf_dir).withColumn("timestamp", F.lit(""))
    return hits.select(F.col("hit_no").cast("long").alias("no"), sinks.csv_record(hits, HIT_COLUMNS).alias("record"))


_BY_FILE = f"""{_EVENT_CTX}, {_COVER}, found AS (SELECT c.artifact_path, any_value(artifact_family) AS artifact_family, count(h.rule_id) AS hit_count, {_SEV}, coalesce(string_agg(DISTINCT rule_id, ';' ORDER BY rule_id), '') AS matched_rule_ids,
  any_value(limitations) AS limitations FROM cover c LEFT JOIN hits h USING (artifact_path) GROUP BY c.artifact_path)"""


@query("findings_by_file_csv", f"{_BY_FILE} SELECT CAST(row_number() OVER (ORDER BY artifact_path) AS BIGINT) AS no, {_record_sql(FILE_FINDING_COLUMNS, {})} AS record FROM found")
def findings_by_file_csv(spark, sf_dir):
    """Findings by file as CSV records in the order of their paths."""
    from ..operators.ordered import running

    df = G.findings_by_file(_event_coverage(spark, sf_dir), _event_hits(spark, sf_dir))
    told = df.select("artifact_path", sinks.csv_record(df, FILE_FINDING_COLUMNS).alias("record"))
    return running(told, ["artifact_path"], {"n": F.lit(1).cast("long")}).select((F.col("n") + 1).alias("no"), "record")


_FIRST_ITEMS = [k for k, (f, i) in enumerate((f, i) for f, items in fixed.CHECKLIST.items() for i in items) if i == fixed.CHECKLIST[f][0]]


@query("checklist_lines", f"""{_EVIDENCE}, {_ITEM_SQL}, o AS (SELECT item_ord, family, item, {_ALIAS_SQL} ELSE EXISTS (SELECT 1 FROM available WHERE contains(lower(item), token) OR contains(token, lower(item))) END AS observed FROM items)
SELECT string_agg(CASE WHEN item_ord IN ({', '.join(map(str, _FIRST_ITEMS))}) THEN CASE WHEN item_ord > 0 THEN chr(10) ELSE '' END || family || chr(10) || repeat('-', length(family)) || chr(10) ELSE '' END
  || '- [' || CASE WHEN observed THEN 'observed' ELSE 'missing' END || '] ' || item, chr(10) ORDER BY item_ord) AS text FROM o""")
def checklist_lines(spark, sf_dir):
    """The checklist file's text below its head."""
    rows = G.checklist(_event_coverage(spark, sf_dir), _event_hits(spark, sf_dir)).collect()  # as many as the checklist has items
    return spark.createDataFrame([(sinks.checklist_text(rows).split("\n", len(fixed.CHECKLIST_HEAD))[-1].rstrip("\n"),)], "text string")
