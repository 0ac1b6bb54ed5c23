"""Queries of the triage engine by name, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed, sinks
from ..functions.rules import built_in, dynamic_hits, rule_match, rules_table
from ..functions.text import split_lines
from ..lineage import cut_lineage
from ..operators import casenum
from ..operators import findings as G
from ..operators.classify import by_suffix, marker_family
from ..operators.coverage import classified, coverage
from ..operators.scan import binary_hits, fragments, hits_in_order, line_arrays, pattern_flags, row_hits, with_context
from ..schema import RULE_FINDING_COLUMNS
from ..sources.artifacts import from_contents, from_table
from ..streaming.dropfolder import windowed_hits
from . import blocked, bundled, indexed  # noqa: F401
from . import views as V
from .register import ORACLE_SQL, QUERIES, query  # noqa: F401

FLAGSHIP = "findings_by_rule"
_PACK = built_in()


def _event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_hits(V.event_lines(spark, sf_dir), _PACK)


def _event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event logs as scanned artifacts: users by remainder are of three families."""
    lines = V.event_lines(spark, sf_dir)
    by = lines.groupBy("artifact_path").agg(F.count("*").alias("lines_or_rows_scanned"), F.sum(F.length("raw_line").cast("long")).alias("bytes_scanned"), F.bit_or(pattern_flags(F.col("raw_line"))).alias("flags"))
    k = F.regexp_extract("artifact_path", r"(\d+)", 1).cast("long") % 3
    family = F.when(k == 0, "agent_trace_bt9").when(k == 1, "server_bt9").otherwise("text_log")
    return by.withColumns({"artifact_ord": F.col("artifact_path"), "artifact_family": family, "review_mode": F.when(k == 2, "unreadable").otherwise("stream-scanned"), "limitations": F.when(k == 2, "late").otherwise(""), "decoder_status": F.lit("scanned")})


_EVENT_CTX = f"WITH {V.EVENT_LINES}, {V.CONTEXT}, {V.hits_sql()}"
_K = "CAST(regexp_extract(artifact_path, '(\\d+)', 1) AS BIGINT) % 3"
_COVER = f"""cover AS (SELECT artifact_path, count(*) AS n, sum(length(raw_line)) AS size, CASE {_K} WHEN 0 THEN 'agent_trace_bt9' WHEN 1 THEN 'server_bt9' ELSE 'text_log' END AS artifact_family,
  CASE {_K} WHEN 2 THEN 'unreadable' ELSE 'stream-scanned' END AS review_mode, CASE {_K} WHEN 2 THEN 'late' ELSE '' END AS limitations FROM lines GROUP BY artifact_path)"""


@query("line_split_counts", f"WITH {V.DOCUMENT_LINES} SELECT artifact_path, CAST(len(s) AS BIGINT) AS n_lines FROM parts")
def line_split_counts(spark, sf_dir):
    """Lines per document file."""
    docs = V.read_texts(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("artifact_path"), F.size(split_lines(F.coalesce("text", F.lit("")))).cast("long").alias("n_lines"))


@query("keyword_hits", f"WITH {V.DOCUMENT_LINES}, {V.hits_sql(source='lines')} SELECT artifact_path, CAST(line_number AS BIGINT) AS line_number, matched_text, raw_line FROM hits")
def keyword_hits(spark, sf_dir):
    """Hits of the built-in pack in document lines."""
    return row_hits(V.document_lines(spark, sf_dir), _PACK).select("artifact_path", "line_number", "matched_text", "raw_line")


@query("keyword_hits_by_term", f"WITH {V.EVENT_LINES}, {V.hits_sql(source='lines')} SELECT matched_text AS term, count(*) AS hit_count, count(DISTINCT artifact_path) AS file_count FROM hits WHERE rule_id = 'GENERIC_SEARCH' GROUP BY 1")
def keyword_hits_by_term(spark, sf_dir):
    hits = _event_hits(spark, sf_dir).filter(F.col("rule_id") == fixed.GENERIC_RULE)
    return hits.groupBy(F.col("matched_text").alias("term")).agg(F.count("*").alias("hit_count"), F.count_distinct("artifact_path").alias("file_count"))


_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(raw_line, '(?i){p}') THEN regexp_extract(raw_line, '(?i){p}')" for p in V.PROSE.rules[0].patterns) + " END"


@query("rule_hits_first_pattern", f"WITH {V.DOCUMENT_LINES} SELECT * FROM (SELECT artifact_path, CAST(line_number AS BIGINT) AS line_number, {_FIRST} AS matched_text FROM lines) WHERE matched_text IS NOT NULL")
def rule_hits_first_pattern(spark, sf_dir):
    """What the first matching pattern of one rule finds."""
    lines = V.document_lines(spark, sf_dir)
    return lines.select("artifact_path", "line_number", rule_match(F.col("raw_line"), V.PROSE.rules[0]).alias("matched_text")).filter("matched_text is not null")


@query("all_hits", f"{_EVENT_CTX} SELECT printf('H%06d', row_number() OVER (ORDER BY artifact_path, line_number, rule_ord)) AS hit_id, rule_id, severity, product, issue_category, component, artifact_path, CAST(line_number AS BIGINT) AS line_number, matched_text, raw_line, context_before, context_after, kb_candidate_ids FROM hits")
def all_hits(spark, sf_dir):
    """Every hit of the event logs in scan order, with context and number."""
    return hits_in_order(V.event_lines(spark, sf_dir), _PACK).select("hit_id", "rule_id", "severity", "product", "issue_category", "component", "artifact_path", "line_number", "matched_text", "raw_line", "context_before", "context_after", "kb_candidate_ids")


@query("hits_with_context", f"WITH {V.DOCUMENT_LINES}, {V.CONTEXT}, {V.hits_sql(V.PROSE)} SELECT artifact_path, CAST(line_number AS BIGINT) AS line_number, rule_id, matched_text, context_before, context_after FROM hits")
def hits_with_context(spark, sf_dir):
    """Hits of a caller's pack in documents, context cut from arrays of lines."""
    from ..operators.scan import line_arrays, text_hits

    files = V.document_files(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("").cast("binary")))
    return text_hits(line_arrays(files), V.PROSE).select("artifact_path", "line_number", "rule_id", "matched_text", "context_before", "context_after")


@query("conversation_context", f"WITH {V.TURN_LINES}, {V.CONTEXT} SELECT artifact_path, CAST(line_number AS BIGINT) AS line_number, raw_line, context_before, context_after FROM ctx")
def conversation_context(spark, sf_dir):
    """Two turns around every turn, by windows over blocks of lines."""
    return with_context(V.turn_lines(spark, sf_dir)).select("artifact_path", "line_number", "raw_line", "context_before", "context_after")


_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({V._q(r.rule_id)}, {V._q(r.missing_evidence)}, {V._q(r.false_positive_cautions)})" for r in _PACK.rules) + ") t(rule_id, miss, caution))"
_FINDINGS = f"""{_EVENT_CTX}, {_RULES_SQL}, g AS (SELECT rule_id, count(*) AS hit_count, string_agg(DISTINCT artifact_path, ';' ORDER BY artifact_path) AS artifacts_hit,
  arg_min(struct_pack(p := product, i := issue_category, c := component, s := severity, k := kb_candidate_ids, f := artifact_path, n := line_number), (artifact_path, line_number, rule_ord)) AS x FROM hits GROUP BY rule_id),
found AS (SELECT g.rule_id, x.p AS product, x.i AS issue_category, x.c AS component, x.s AS severity, hit_count, artifacts_hit, x.f AS first_seen_file, CAST(x.n AS VARCHAR) AS first_seen_line, x.k AS kb_candidate_ids,
  CASE WHEN miss IS NULL THEN '{fixed.STATUS_GENERIC}' ELSE '{fixed.STATUS_RULE}' END AS required_evidence_status, coalesce(miss, '{fixed.STATUS_GENERIC}') AS missing_evidence, coalesce(caution, '{fixed.CAUTION_GENERIC}') AS false_positive_cautions
  FROM g LEFT JOIN rules USING (rule_id))"""


@query("findings_by_rule", f"{_FINDINGS} SELECT * FROM found")
def findings_by_rule(spark, sf_dir):
    """Flagship: hits of the event logs by rule, with first place seen and what is missing."""
    return G.findings_by_rule(_event_hits(spark, sf_dir), _PACK)


@query("findings_by_rule_csv", _FINDINGS + " SELECT " + " || ',' || ".join(f"'\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"'" for c in RULE_FINDING_COLUMNS) + " AS record FROM found")
def findings_by_rule_csv(spark, sf_dir):
    """The same as CSV records, every field quoted."""
    df = G.findings_by_rule(_event_hits(spark, sf_dir), _PACK)
    return df.select(sinks.csv_record(df, RULE_FINDING_COLUMNS).alias("record"))


_SEV = ", ".join(f"count(*) FILTER (lower(severity) = '{s.lower()}') AS {s.lower()}_count" for s in fixed.SEVERITIES)


@query("findings_by_file", f"{_EVENT_CTX}, {_COVER} SELECT c.artifact_path, any_value(artifact_family) AS artifact_family, count(h.rule_id) AS hit_count, {_SEV}, coalesce(string_agg(DISTINCT rule_id, ';' ORDER BY rule_id), '') AS matched_rule_ids, any_value(limitations) AS limitations FROM cover c LEFT JOIN hits h USING (artifact_path) GROUP BY c.artifact_path")
def findings_by_file(spark, sf_dir):
    """Hits by file and severity, files without hits too."""
    return G.findings_by_file(_event_coverage(spark, sf_dir), _event_hits(spark, sf_dir))


@query("severity_counts", f"{_EVENT_CTX} SELECT {_SEV} FROM hits")
def severity_counts(spark, sf_dir):
    return G.severity_counts(_event_hits(spark, sf_dir))


@query("scan_summary", f"{_EVENT_CTX} SELECT count(*) AS hit_count, count(DISTINCT rule_id) AS rule_count, CASE WHEN bool_or(product = '{fixed.PRODUCT}') THEN '{fixed.PRODUCT}' ELSE 'Unknown' END AS product FROM hits")
def scan_summary(spark, sf_dir):
    return G.scan_summary(_event_hits(spark, sf_dir))


@query("scanned_count", f"WITH {V.EVENT_LINES}, {_COVER} SELECT count(*) AS artifact_count, count(*) FILTER (review_mode IN ('stream-scanned', 'binary-string-scanned') OR n > 0 OR size > 0) AS scanned_count FROM cover")
def scanned_count(spark, sf_dir):
    return G.scanned_count(_event_coverage(spark, sf_dir))


_KB = "kb(kb_id, title) AS (VALUES " + ", ".join(f"({V._q(k)}, {V._q(t)})" for k, t in _PACK.kb_titles.items()) + ")"


@query("kb_candidates", f"{_EVENT_CTX}, {_KB}, ids AS (SELECT DISTINCT replace(c, 'KB candidate ', '') AS kb_id FROM (SELECT unnest(string_split(kb_candidate_ids, ';')) AS c FROM hits) WHERE c <> '') SELECT kb_id, coalesce(title, 'Unknown title') AS title FROM ids LEFT JOIN kb USING (kb_id)")
def kb_candidates(spark, sf_dir):
    return G.kb_list(_event_hits(spark, sf_dir), _PACK)


_SPECS = "specs(spec_ord, message, needle, needle2, target) AS (VALUES " + ", ".join(f"({k}, {V._q(m)}, {V._q(n[0]) if n else 'NULL'}, {V._q(n[-1]) if n else 'NULL'}, {V._q(t)})" for k, (m, _, n, t) in enumerate(fixed.NEGATIVE_SEARCHES)) + ")"
_WANTED = "wanted(spec_ord, artifact_family) AS (VALUES " + ", ".join(f"({k}, '{f}')" for k, (_, fs, _, _) in enumerate(fixed.NEGATIVE_SEARCHES) for f in fs) + ")"


@query("negative_searches", f"""WITH {V.EVENT_LINES}, {_COVER}, {_SPECS}, {_WANTED}, seen AS (SELECT l.raw_line, c.artifact_family FROM lines l JOIN cover c USING (artifact_path) WHERE review_mode = 'stream-scanned')
SELECT spec_ord, message FROM specs s WHERE EXISTS (SELECT 1 FROM wanted w JOIN seen USING (artifact_family) WHERE w.spec_ord = s.spec_ord)
AND NOT EXISTS (SELECT 1 FROM seen WHERE artifact_family = s.target)
AND NOT EXISTS (SELECT 1 FROM wanted w JOIN seen USING (artifact_family) WHERE w.spec_ord = s.spec_ord AND contains(lower(raw_line), s.needle) AND contains(lower(raw_line), s.needle2))""")
def negative_searches(spark, sf_dir):
    return G.negative_searches(_event_coverage(spark, sf_dir))


_TOKENS = "tokens(token) AS (VALUES " + ", ".join(f"('{t}')" for t in fixed.EVIDENCE_TOKENS) + ")"
_EVIDENCE = f"""{_EVENT_CTX}, {_COVER}, {_TOKENS}, available AS (SELECT token FROM tokens WHERE EXISTS (SELECT 1 FROM cover WHERE contains(lower(artifact_path), token)) OR EXISTS (SELECT 1 FROM hits WHERE contains(lower(raw_line || chr(10) || matched_text), token))
  UNION SELECT lower(artifact_family) FROM cover)"""


@query("evidence_tokens", f"{_EVIDENCE} SELECT token FROM available")
def evidence_tokens(spark, sf_dir):
    return G.available_evidence(_event_coverage(spark, sf_dir), cut_lineage(_event_hits(spark, sf_dir)))


_ITEMS = [(f, i) for f, items in fixed.CHECKLIST.items() for i in items]
_ITEM_SQL = "items(item_ord, family, item) AS (VALUES " + ", ".join(f"({k}, {V._q(f)}, {V._q(i)})" for k, (f, i) in enumerate(_ITEMS)) + ")"
_ALIAS_SQL = "CASE " + " ".join(f"WHEN contains(lower(item), '{k}') THEN EXISTS (SELECT 1 FROM available WHERE token IN ({', '.join(V._q(x) for x in a)}))" for k, a in fixed.EVIDENCE_ALIASES.items())


@query("missing_evidence", f"{_EVIDENCE}, {_ITEM_SQL} SELECT item_ord, family, item, {_ALIAS_SQL} ELSE EXISTS (SELECT 1 FROM available WHERE contains(lower(item), token) OR contains(token, lower(item))) END AS observed FROM items")
def missing_evidence(spark, sf_dir):
    return G.checklist(cut_lineage(_event_coverage(spark, sf_dir)), cut_lineage(_event_hits(spark, sf_dir)))


def _marker_sql(text: str) -> str:
    count = lambda ms: " + ".join(f"CAST(contains({text}, {V._q(m.lower())}) AS INT)" for m in ms)
    parts = [f"struct_pack(n := {count(ms)}, o := {-k}, f := '{f}')" for k, (f, ms) in enumerate(fixed.MARKERS.items())]
    strong = " OR ".join(f"contains({text}, {V._q(m.lower())})" for m in fixed.STRONG_MARKERS)
    return f"list_sort([{', '.join(parts)}], 'DESC')[1] AS best, ({strong}) AS strong"


@query("marker_families", f"WITH {V.TURN_LINES}, t AS (SELECT artifact_path, {_marker_sql('lower(raw_line)')} FROM lines UNION ALL SELECT DISTINCT event_type, {_marker_sql('lower(' + V._CASE + ')')} FROM events) SELECT artifact_path, CASE WHEN best.n >= 2 OR (best.n = 1 AND strong) THEN best.f END AS family FROM t")
def marker_families(spark, sf_dir):
    """Families by content markers, ties by order."""
    turns = V.turn_lines(spark, sf_dir).select("artifact_path", "raw_line")
    message = F.lit("")
    for kind, text in V.MESSAGES.items():
        message = F.when(F.col("event_type") == kind, text).otherwise(message)
    kinds = V.read(spark, sf_dir, "events").select(F.col("event_type").alias("artifact_path"), message.alias("raw_line")).distinct()
    return turns.unionByName(kinds).select("artifact_path", marker_family(F.col("raw_line")).alias("family"))


@query("page_families", f"WITH {V.probe_sql('html', 'pages', 'page_id')}, t AS (SELECT page_id, ltrim(head, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, {_marker_sql('lower(head)')} FROM probed) SELECT page_id, CASE WHEN best.n >= 2 OR (best.n = 1 AND strong) THEN best.f WHEN starts_with(s, '<?xml') OR starts_with(s, '<Event') THEN 'xml' WHEN contains(lower(s[1:512]), '<html') OR contains(lower(s[1:512]), '<!doctype html') THEN 'html' ELSE 'text_log' END AS family FROM t")
def page_families(spark, sf_dir):
    """Pages classified by content before name; markers are looked for in the first 4096 bytes."""
    pages = V.read_texts(spark, sf_dir, "pages")
    found = classified(from_table(pages, F.concat(F.col("page_id").cast("string"), F.lit(".log")), F.coalesce("html", F.lit(""))))
    return found.select(F.regexp_extract("artifact_path", r"\d+", 0).cast("long").alias("page_id"), F.col("cls.family").alias("family"))


_NAMES = "'f' || page_id || CASE page_id % 9 WHEN 0 THEN '.log' WHEN 1 THEN '.JSON' WHEN 2 THEN '.tar.gz' WHEN 3 THEN ' Standard-Report.pdf' WHEN 4 THEN '.evtx' WHEN 5 THEN '.htm' WHEN 6 THEN '.bt9' WHEN 7 THEN '.tiff' ELSE '' END"


@query("suffix_families", f"SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'text_log' WHEN 1 THEN 'json' WHEN 2 THEN 'tar' WHEN 3 THEN 'standard_report_pdf' WHEN 4 THEN 'evtx' WHEN 5 THEN 'html' WHEN 7 THEN 'image_metadata_only' END AS family, CASE page_id % 9 WHEN 0 THEN 'extension:.log' WHEN 1 THEN 'extension:.json' WHEN 2 THEN 'extension:tar' WHEN 3 THEN 'extension:.pdf:name:standard-report' WHEN 4 THEN 'extension:.evtx' WHEN 5 THEN 'extension:.htm' WHEN 7 THEN 'extension:.tiff' END AS identified_by FROM pages")
def suffix_families(spark, sf_dir):
    """Families by name alone."""
    name = F.expr(_NAMES)
    return V.read(spark, sf_dir, "pages").select("page_id", by_suffix(name).alias("c")).select("page_id", "c.family", "c.identified_by")


@query("artifact_coverage", f"WITH {V.DOCUMENT_LINES}, {V.probe_sql('text', 'documents', 'doc_id')}, t AS (SELECT doc_id, t, {_marker_sql('lower(head)')} FROM probed) SELECT 'doc-' || doc_id || '.txt' AS artifact_path, CASE WHEN best.n >= 2 OR (best.n = 1 AND strong) THEN best.f ELSE 'text_log' END AS artifact_family, 'stream-scanned' AS review_mode, CAST(len(s) AS BIGINT) AS lines_or_rows_scanned, CAST(strlen(t) AS BIGINT) AS bytes_scanned, 'utf-8' AS encoding, true AS decoded_successfully FROM t JOIN parts ON parts.artifact_path = 'doc-' || doc_id || '.txt'")
def artifact_coverage(spark, sf_dir):
    """Coverage rows of all documents as text files."""
    return coverage(classified(V.document_files(spark, sf_dir))).select("artifact_path", "artifact_family", "review_mode", "lines_or_rows_scanned", "bytes_scanned", "encoding", "decoded_successfully")


@query("coverage_dedup_last", "SELECT artifact_path, arg_max(artifact_family, artifact_ord) AS artifact_family, max(artifact_ord) AS artifact_ord FROM (SELECT 'user-' || user_id AS artifact_path, event_type AS artifact_family, CAST(event_id AS VARCHAR) AS artifact_ord FROM events) GROUP BY 1")
def coverage_dedup_last(spark, sf_dir):
    """Of rows with one path the last."""
    rows = V.read(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("artifact_path"), F.col("event_type").alias("artifact_family"), F.col("event_id").cast("string").alias("artifact_ord"))
    return G.last_rows(rows)


@query("duplicate_content", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST(row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS INT) AS copy_no FROM documents QUALIFY copy_no > 1")
def duplicate_content(spark, sf_dir):
    """Documents whose content came before; a third pass over the digests alone."""
    docs = V.read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    w = Window.partitionBy("digest").orderBy("doc_id")
    return docs.join(first, "digest").withColumn("copy_no", F.row_number().over(w)).filter("copy_no > 1").select("doc_id", "digest", "copy_no")


_PATHS = "'/cases/' || (60000000 + o_custkey % 37) || '/log' || o_orderkey || '_' || (60000000 + o_orderkey % 11) || '.txt'"
_MENTIONS = f"m AS (SELECT o_orderkey, unnest(['/cases/' || a || '/', 'x']) AS part, a, b FROM (SELECT o_orderkey, CAST(60000000 + o_custkey % 37 AS VARCHAR) AS a, CAST(60000000 + o_orderkey % 11 AS VARCHAR) AS b FROM orders)), one AS (SELECT o_orderkey * 2 + CASE part WHEN 'x' THEN 1 ELSE 0 END AS ord, CASE part WHEN 'x' THEN b ELSE a END AS case_number FROM m)"


@query("case_number_mode", f"WITH {_MENTIONS}, g AS (SELECT case_number, count(*) AS n, min(ord) AS f FROM one GROUP BY 1), top AS (SELECT * FROM g WHERE n = (SELECT max(n) FROM g)) SELECT CASE WHEN (SELECT count(*) FROM top) = 1 THEN (SELECT case_number FROM top) ELSE (SELECT arg_min(case_number, f) FROM g) END AS case_number, (SELECT count(*) FROM top) > 1 AS ambiguous")
def case_number_mode(spark, sf_dir):
    """The case number that paths mention most."""
    paths = V.read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PATHS).alias("path"))
    found = paths.select("o_orderkey", F.posexplode(casenum.in_path(F.col("path"))).alias("i", "case_number"))
    return casenum.most_common(found.select((F.col("o_orderkey") * 2 + F.col("i")).alias("ord"), "case_number"))


@query("case_numbers_in_text", "SELECT o_orderkey, CAST(60000000 + o_custkey AS VARCHAR) AS case_number, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY ALL")
def case_numbers_in_text(spark, sf_dir):
    """Case numbers that report texts call so, in all four spellings."""
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'See Case Number: ' WHEN 1 THEN 'our CASE # ' WHEN 2 THEN 'case-' WHEN 3 THEN 'the case  ' ELSE 'order ' END || (60000000 + o_custkey) || ' closed'")
    found = V.read(spark, sf_dir, "orders").select("o_orderkey", F.explode(casenum.in_text(text)).alias("case_number"))
    return found.groupBy("o_orderkey", "case_number").agg(F.count("*").alias("n"))


@query("warnings_distinct", f"WITH {V.EVENT_LINES}, {_COVER} SELECT artifact_path || ': ' || limitations AS warning, artifact_path AS first_ord FROM cover WHERE limitations <> ''")
def warnings_distinct(spark, sf_dir):
    return G.warnings(_event_coverage(spark, sf_dir))


@query("ascii_fragments", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7e]{4,}') AS m, string_split_regex(text, '[\x20-\x7e]{4,}') AS g FROM documents)
SELECT 'doc-' || doc_id || '.txt' AS artifact_path, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS byte_offset, m[i] AS raw_line
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t)""")
def ascii_fragments(spark, sf_dir):
    """Printable runs of the documents' bytes with their offsets."""
    return fragments(V.document_files(spark, sf_dir)).filter("kind_ord = 0").select("artifact_path", "byte_offset", "raw_line")


@query("dynamic_rule_join", f"WITH {V.EVENT_LINES}, {V.hits_sql(source='lines')} SELECT artifact_path, CAST(line_number AS BIGINT) AS line_number, rule_id, matched_text FROM hits WHERE rule_id <> 'GENERIC_SEARCH'")
def dynamic_rule_join(spark, sf_dir):
    """Rules that come as a table instead of a compiled pack."""
    lines = V.event_lines(spark, sf_dir).select("artifact_path", "line_number", "raw_line")
    return dynamic_hits(lines, rules_table(spark, _PACK)).select("artifact_path", "line_number", "rule_id", "matched_text")


@query("hits_by_hour", f"WITH {V.EVENT_LINES}, {V.hits_sql(source='lines')} SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, rule_id, severity, count(*) AS hit_count FROM hits GROUP BY ALL")
def hits_by_hour(spark, sf_dir):
    """Hits by hour and rule; the same function serves streams."""
    events = V.event_lines(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_hits(events, _PACK)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("archive_lineage", "SELECT 'b' || (doc_id % 50) || '.zip' || '!' || doc_id AS artifact_path, 'b' || (doc_id % 50) || '.zip' AS extracted_from, CASE WHEN doc_id % 50 < 40 THEN 'zip' END AS parent_family FROM documents")
def archive_lineage(spark, sf_dir):
    """Children joined with the archive they came out of."""
    docs = V.read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), "doc_id")
    parent = F.concat(F.lit("b"), F.col("k").cast("string"), F.lit(".zip"))
    kids = docs.select(F.concat(parent, F.lit("!"), F.col("doc_id").cast("string")).alias("artifact_path"), parent.alias("extracted_from"), F.lit("text_log").alias("artifact_family"))
    parents = docs.filter("k < 40").select(parent.alias("artifact_path"), F.lit("").alias("extracted_from"), F.lit("zip").alias("artifact_family")).distinct()
    rows = kids.unionByName(parents).withColumns({"artifact_ord": F.col("artifact_path"), "identified_by": F.lit("content:zipfile")})
    return G.lineage(rows).select("artifact_path", "extracted_from", "parent_family")


@query("not_decoded", f"WITH {V.EVENT_LINES}, {_COVER} SELECT artifact_path || ' (' || artifact_family || '; ' || review_mode || ') ' || limitations AS line FROM cover WHERE review_mode <> 'stream-scanned'")
def not_decoded(spark, sf_dir):
    """What the reports list as not decoded."""
    cover = _event_coverage(spark, sf_dir).filter("review_mode <> 'stream-scanned'")
    return cover.select(F.format_string("%s (%s; %s) %s", "artifact_path", "artifact_family", "review_mode", "limitations").alias("line"))


_RUNS = r"regexp_extract_all(text, '[\x20-\x7e]{4,}') AS m, string_split_regex(text, '[\x20-\x7e]{4,}') AS g"


@query("utf16_fragments", rf"""WITH t AS (SELECT doc_id, {_RUNS} FROM documents)
SELECT 'doc-' || doc_id || '.bin' AS artifact_path, CAST(1 + doc_id % 2 AS INT) AS kind_ord, CAST(doc_id % 2 + 2 * (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) AS BIGINT) AS byte_offset, m[i] AS raw_line
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t)""")
def utf16_fragments(spark, sf_dir):
    """Wide printable runs of the documents' UTF-16LE bytes, at even and odd offsets."""
    wide = F.concat(F.when(F.col("doc_id") % 2 == 1, F.lit(b"\x01")).otherwise(F.lit(b"")), F.encode(F.coalesce("text", F.lit("")), "UTF-16LE"))
    docs = V.read_texts(spark, sf_dir, "documents").select(_bin_name("doc_id").alias("artifact_ord"), _bin_name("doc_id").alias("artifact_path"), wide.alias("content"))
    return fragments(docs).filter("kind_ord > 0").select("artifact_path", "kind_ord", "byte_offset", "raw_line")


def _bin_name(column: str):
    return F.concat(F.lit("doc-"), F.col(column).cast("string"), F.lit(".bin"))


@query("chunk_cut_fragments", """SELECT n_name AS artifact_path, CAST(1048576 - 2 * n_nationkey AS BIGINT) AS byte_offset, left(n_name || ' and what follows it', CASE WHEN n_nationkey = 0 THEN 1000 ELSE 2 * n_nationkey END) AS raw_line
FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT n_name, CAST(10 AS BIGINT), 'begin' FROM nation""")
def chunk_cut_fragments(spark, sf_dir):
    """Runs that cross the end of a 1 MiB chunk are seen as far as the chunk; with less than four characters of room they are not."""
    gap = F.expr("repeat(chr(1), cast(1048576 - 15 - 2 * n_nationkey as int))")
    content = F.concat(F.expr("repeat(chr(1), 10)"), F.lit("begin"), gap, F.col("n_name"), F.lit(" and what follows it")).cast("binary")
    return fragments(V.read(spark, sf_dir, "nation").select(F.col("n_name").alias("artifact_ord"), F.col("n_name").alias("artifact_path"), content.alias("content"))).select("artifact_path", "byte_offset", "raw_line")


_TERMS = "terms(term) AS (VALUES " + ", ".join(f"({V._q(t)})" for t in _PACK.terms) + ")"


@query("binary_term_hits", rf"""WITH t AS (SELECT doc_id, {_RUNS} FROM (SELECT doc_id, coalesce(text, '') || chr(1) || 'DNS and Proxy ' || doc_id || chr(2) || 'tls' || chr(3) || 'Access Denied' AS text FROM documents)), {_TERMS},
r AS (SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS byte_offset, m[i] AS raw_line FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t))
SELECT 'doc-' || doc_id || '.bin' AS artifact_path, byte_offset, 'GENERIC_SEARCH' AS rule_id, term AS matched_text, raw_line, 'ascii-string' AS match_type, 'binary-string-scanner' AS scanner, 'binary' AS encoding FROM r, terms WHERE contains(lower(raw_line), term)""")
def binary_term_hits(spark, sf_dir):
    """Terms in printable runs of binary content; rules are not tried there."""
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\x01DNS and Proxy "), F.col("doc_id").cast("string"), F.lit("\x02tls\x03Access Denied")).cast("binary")
    docs = V.read_texts(spark, sf_dir, "documents").select(_bin_name("doc_id").alias("artifact_ord"), _bin_name("doc_id").alias("artifact_path"), content.alias("content"))
    return binary_hits(fragments(docs).filter("kind_ord = 0"), _PACK).select("artifact_path", "byte_offset", "rule_id", "matched_text", "raw_line", "match_type", "scanner", "encoding")


@query("decode_chain", r"""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'utf-8-sig' WHEN doc_id % 5 = 3 THEN 'latin-1' WHEN doc_id % 5 = 4 THEN 'utf-16' WHEN doc_id % 5 = 2 AND regexp_matches(t, '[\x{a0}-\x{ff}]') THEN 'cp1252' ELSE 'utf-8' END AS encoding,
CAST(len(CASE WHEN s[-1] = '' THEN s[1 : len(s) - 1] ELSE s END) AS BIGINT) AS n_lines, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT doc_id, t, string_split_regex(t, '\r\n|\r|\n') AS s FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 3 THEN chr(129) ELSE '' END AS t FROM documents))""")
def decode_chain(spark, sf_dir):
    """Marks and strict decodings in turn: the documents as UTF-8, UTF-8 with a mark, cp1252, latin-1 with an odd byte, UTF-16 with a mark."""
    files = V.read_texts(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), V.encoded_text().alias("content"))
    x = line_arrays(from_contents(files), V.told_encodings(spark, sf_dir))
    return x.select(F.col("artifact_path").cast("long").alias("doc_id"), "encoding", F.size("lines").cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


_HEADS = ["<?xml version=\"1.0\"?><a>", "{\"k\": [1, 2], \"s\": \"x\"}", "{\"k\": 1} trailing", "  <Event a=\"1\"/>", "<!-- x --><!DOCTYPE HTML>", "plain words", "\\x00\\x01 bytes", "[not json"]


@query("content_families", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'html' WHEN 6 THEN 'opaque_binary' ELSE 'text_log' END AS family,
CASE page_id % 8 WHEN 0 THEN 'content:xml' WHEN 1 THEN 'content:json' WHEN 3 THEN 'content:xml' WHEN 4 THEN 'content:html' WHEN 6 THEN 'fallback:binary' ELSE 'content:text' END AS identified_by,
CASE page_id % 8 WHEN 6 THEN 'binary-string-scanned' ELSE 'stream-scanned' END AS review_mode FROM pages""")
def content_families(spark, sf_dir):
    """Families of files without a suffix, by their first bytes: XML, JSON that parses, HTML, text, bytes with NUL."""
    head = F.get(F.array(*[F.lit(h.replace("\\x00\\x01", "\x00\x01")) for h in _HEADS]), (F.col("page_id") % 8).cast("int"))
    files = V.read(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("path"), head.cast("binary").alias("content"))
    found = coverage(classified(from_contents(files)))
    return found.select(F.substring("artifact_path", 2, 30).cast("long").alias("page_id"), F.col("artifact_family").alias("family"), "identified_by", "review_mode")


@query("findings_order", f"{_EVENT_CTX}, one AS (SELECT rule_id, any_value(severity) AS severity FROM hits GROUP BY rule_id) SELECT CAST(row_number() OVER (ORDER BY list_position([{', '.join(V._q(s) for s in fixed.SEVERITIES)}], severity), rule_id) AS INT) AS place, rule_id FROM one")
def findings_order(spark, sf_dir):
    """The order in which the report lists rules: by severity, then by id."""
    found = G.findings_by_rule(_event_hits(spark, sf_dir), _PACK)
    return found.select(F.row_number().over(Window.orderBy(G.severity_rank(F.col("severity")), "rule_id")).alias("place"), "rule_id")


@query("rule_files", f"{_EVENT_CTX} SELECT rule_id, artifact_path, count(*) AS hit_count FROM hits GROUP BY ALL")
def rule_files(spark, sf_dir):
    """Rules and files as rows."""
    return G.rule_files(_event_hits(spark, sf_dir))


_STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'scan-failed' WHEN 1 THEN 'unsafe-archive-path-refused' WHEN 2 THEN 'archive-loop-detected' WHEN 3 THEN 'scanned' WHEN 4 THEN 'unreadable' ELSE 'metadata-only' END"


@query("warnings_by_status", f"SELECT 'w' || o_custkey || ': ' || {_STATUS} AS warning, min('w' || o_orderkey) AS first_ord FROM orders WHERE o_orderkey % 6 NOT IN (3, 5) GROUP BY 1")
def warnings_by_status(spark, sf_dir):
    """Warnings that come from a status alone, each once, with where it came first."""
    rows = V.read(spark, sf_dir, "orders").select(F.expr("'w' || o_orderkey").alias("artifact_ord"), F.expr("'w' || o_custkey").alias("artifact_path"), F.lit("").alias("limitations"), F.expr(_STATUS).alias("decoder_status"))
    return G.warnings(rows)


@query("policy_rows", """SELECT 's' || s_suppkey AS artifact_path, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'zip' END AS artifact_family, CASE s_suppkey % 3 WHEN 0 THEN 'hash:sha256' ELSE 'content:zipfile' END AS identified_by,
CASE s_suppkey % 3 WHEN 0 THEN 'skipped-by-policy' ELSE 'metadata-only' END AS review_mode, CASE s_suppkey % 3 WHEN 0 THEN 'archive-loop-detected' WHEN 1 THEN 'extracted-with-limitations' ELSE 'archive-detected' END AS decoder_status,
CASE s_suppkey % 3 WHEN 0 THEN 'seen before' WHEN 1 THEN 'one two' ELSE '' END AS limitations, CASE WHEN s_suppkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE strlen(s_name) END AS bytes_scanned, false AS decoded_successfully, 'none' AS decoder_used FROM supplier""")
def policy_rows(spark, sf_dir):
    """Coverage of what is not scanned: policy rows, archives with and without limitations of their members."""
    base = from_table(V.read(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_name"))
    number = F.substring("artifact_path", 2, 20).cast("long") % 3
    policy = F.struct(*[F.lit(v).alias(n) for n, v in (("family", "unknown"), ("identified_by", "hash:sha256"), ("review_mode", "skipped-by-policy"), ("status", "archive-loop-detected"), ("limitations", "seen before"))])
    rows = base.withColumns({"policy": F.when(number == 0, policy), "is_zip": F.lit(True), "archive_limitations": F.when(number == 1, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))})
    return coverage(classified(rows)).select("artifact_path", "artifact_family", "identified_by", "review_mode", "decoder_status", "limitations", "bytes_scanned", "decoded_successfully", "decoder_used")


from . import reported  # noqa: E402, F401  (it uses what is above)
