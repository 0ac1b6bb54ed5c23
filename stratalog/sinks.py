"""Reports: CSV, text and HTML files from the engine's tables."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .lineage import cut_lineage
from .operators.ordered import by_ranges

REPORTS = ["artifact_coverage.csv", "all_hits.csv", "findings_by_rule.csv", "findings_by_file.csv", "missing_evidence_checklist.txt", "triage_report.html", "triage_report.txt"]
TITLE = "Log Evidence Triage Report"
TERMINOLOGY = "Observed evidence, likely issue family, KB candidate, missing evidence, limitation."
PURPOSE = "This report records observations only and does not make final-cause conclusions."


def csv_record(df: DataFrame, columns: list[str]) -> Column:
    """A row as one CSV record, every field quoted; booleans as True and False, nulls empty."""
    kinds = dict(df.dtypes)
    fields = []
    for c in columns:
        text = F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
        fields.append(F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.concat_ws(",", *fields)


def write_ordered(lines: DataFrame, order: list[str], path: Path, head: str = "") -> None:
    """One file of ``head`` and the texts of ``lines`` (order columns, text) in their order, written by the executors.

    Texts are dealt by ranges of the order and stored; the sizes of the parts, one row each, give every part its place in the
    file, and each task writes there. A task that is repeated writes the same bytes again. The file has to be in a folder that
    all machines share: a task that does not find it fails.
    """
    parted = by_ranges(lines.select(*order, F.coalesce("text", F.lit("")).alias("text")), order)
    sizes = parted.groupBy("__part").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).orderBy("__part").collect()
    first, at = head.encode(), {}
    end = len(first)
    for r in sizes:
        at[r["__part"]], end = end, end + r["n"]
    with open(path, "wb") as f:
        f.write(first)
        f.truncate(end)
    name, columns = str(path), parted.select("__part", "text")

    def write(batches):
        place, written = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            with open(name, "r+b") as f:
                place = at[b.column(0)[0].as_py()] if place is None else place
                f.seek(place)
                data = "".join(b.column(1).to_pylist()).encode()
                f.write(data)
                place, written = place + len(data), written + len(data)
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    done = columns.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if done + len(first) != end:
        raise RuntimeError(f"{path}: {done + len(first)} bytes written of {end}")


def write_csv(df: DataFrame, columns: list[str], path: Path, order: list[str]) -> None:
    """One CSV file with a header, in the given order, written by the executors."""
    records = df.select(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.concat(csv_record(df, columns), F.lit("\r\n")).alias("text"))
    write_ordered(records, [f"__o{k}" for k in range(len(order))], path, ",".join(f'"{c}"' for c in columns) + "\r\n")


def write_csv_folder(df: DataFrame, columns: list[str], path: str) -> None:
    """A folder of CSV parts without headers, written by the executors: for results too large for one file."""
    df.select(csv_record(df, columns).alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def checklist_text(rows: Iterable) -> str:
    out, last = list(fixed.CHECKLIST_HEAD), None
    for r in rows:
        if r.family != last:
            out += [*([""] if last else []), r.family, "-" * len(r.family)]
            last = r.family
        out.append(f"- [{'observed' if r.observed else 'missing'}] {r.item}")
    return "\n".join(out).rstrip() + "\n"


def _caution(h) -> str:
    return fixed.CAUTION_HIT if h.product == fixed.PRODUCT else fixed.CAUTION_GENERIC


def _status(h) -> str:
    return fixed.STATUS_HIT if h.product == fixed.PRODUCT else fixed.STATUS_GENERIC


def _at(h) -> str:
    return str(h.line_number if h.line_number is not None else h.byte_offset if h.byte_offset is not None else "")


def _fields(h, html_style: bool) -> list[tuple[str, str]]:
    """Labels and values of a finding, in order; the context comes apart in HTML."""
    said = [h.raw_line, h.context_before, h.context_after] if not html_style else []
    why = f"Pattern matched text {h.matched_text}." if html_style else f"Pattern matched text '{h.matched_text}'."
    values = [h.rule_id, h.severity, h.issue_category, h.component, h.artifact_path, _at(h), "", *said, h.kb_candidate_ids, why, _caution(h), _status(h)]
    return list(zip(fixed.LABELS_HTML if html_style else fixed.LABELS_TEXT, values, strict=True))


def _text_finding(h) -> str:
    return "\n".join(f"{'-' if k == 0 else ' '} {label}: {value}" for k, (label, value) in enumerate(_fields(h, False)))


def _html_finding(h) -> str:
    e = html.escape
    told = "<br>".join(f"<strong>{label}:</strong> {e(value)}" for label, value in _fields(h, True))
    return f"<div class='hit'><p>{told}</p><pre>raw_line: {e(h.raw_line)}\ncontext_before: {e(h.context_before)}\ncontext_after: {e(h.context_after)}</pre></div>"


_CSS = """
:root { --line: #b9c4d0; --tint: #eef3f8; --ink: #14202b; }
html { background: var(--tint); color: var(--ink); font: 15px/1.5 "Segoe UI", "Noto Sans", Ubuntu, sans-serif; }
body { max-width: 72rem; margin: 0 auto; padding: 2rem 3rem; background: white; }
h1, h2 { font-weight: 600; letter-spacing: -.01em; }
section { border-top: 2px solid var(--line); margin-top: 2.5rem; }
table { border-spacing: 0; font-size: .9em; }
td { border-bottom: 1px dotted var(--line); padding: .2rem 1.2rem .2rem 0; text-align: left; }
th { text-align: left; padding-right: 1.2rem; }
.hit { border-left: .3rem solid var(--line); padding-left: 1rem; margin-bottom: 1.5rem; }
.hit pre, section > pre { overflow-x: auto; background: var(--tint); padding: .6rem 1rem; font-size: .85em; }
"""


#: Sections of both reports, in order.
(OVERVIEW, PRODUCT, FILES, UNDECODED), FIRST_SEVERITY = range(4), 4
(CHECKLIST, NEGATIVES, KBS, CAUTIONS, APPENDIX, LIMITATIONS) = range(4 + len(fixed.SEVERITIES), 10 + len(fixed.SEVERITIES))
_LINES = "report string, section int, no long, key string, text string"
TEXT, HTML = "text", "html"
_HEAD, _TAIL = -2, 1 << 62


def _lines_of(df: DataFrame, said: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows of _LINES that ``said`` makes of each row."""

    def run(batches):
        for b in batches:
            rows = [x for r in b.to_pylist() for x in said(SimpleNamespace(**r))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()))], names=["report", "section", "no", "key", "text"])

    return df.mapInArrow(run, _LINES)


def _said_of_artifact(r) -> Iterator[tuple]:
    if not r.decoded_successfully and r.review_mode != "stream-scanned":
        yield from _listed(UNDECODED, 0, r.artifact_ord, f"{r.artifact_path} ({r.artifact_family}; {r.review_mode}) {r.limitations}")
    if r.limitations:
        yield from _listed(LIMITATIONS, 0, r.artifact_ord, f"{r.artifact_path}: {r.limitations}", "")


def _said_of_file(r) -> Iterator[tuple]:
    yield TEXT, FILES, 0, r.artifact_path, f"- {r.artifact_path} ({r.artifact_family}) hits={r.hit_count}\n"
    cells = (r.artifact_path, r.artifact_family, r.hit_count, r.matched_rule_ids, r.limitations)
    yield HTML, FILES, 0, r.artifact_path, "<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in cells) + "</tr>\n"


def _escaped(text: Column) -> Column:
    """``html.escape`` of a column."""
    for c in "&<>\"'":
        text = F.replace(text, F.lit(c), F.lit(html.escape(c)))
    return text


def _finding_columns() -> tuple[Column, Column, Column]:
    """What ``_text_finding``, ``_html_finding`` and the text's appendix say of a hit, as columns over its fields."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    at = F.coalesce(F.col("line_number"), F.col("byte_offset")).cast("string")
    by_product = lambda ours, other: F.when(F.col("product") == fixed.PRODUCT, ours).otherwise(other)
    head = [*map(said, ("rule_id", "severity", "issue_category", "component", "artifact_path")), F.coalesce(at, F.lit("")), F.lit("")]
    ends = [by_product(fixed.CAUTION_HIT, fixed.CAUTION_GENERIC), by_product(fixed.STATUS_HIT, fixed.STATUS_GENERIC)]
    kbs, matched, context = said("kb_candidate_ids"), said("matched_text"), [said(c) for c in ("raw_line", "context_before", "context_after")]
    values = [*head, *context, kbs, F.concat(F.lit("Pattern matched text '"), matched, F.lit("'.")), *ends]
    text = [x for k, (label, v) in enumerate(zip(fixed.LABELS_TEXT, values, strict=True)) for x in (F.lit(f"{'-' if k == 0 else chr(10) + ' '} {label}: "), v)]
    values = [*head, kbs, F.concat(F.lit("Pattern matched text "), matched, F.lit(".")), *ends]
    told = [x for k, (label, v) in enumerate(zip(fixed.LABELS_HTML, values, strict=True)) for x in (F.lit(f"{'<br>' if k else ''}<strong>{label}:</strong> "), _escaped(v))]
    lines = [x for k, (c, v) in enumerate(zip(("raw_line", "context_before", "context_after"), context)) for x in (F.lit(f"{chr(10) if k else ''}{c}: "), _escaped(v))]
    marked = F.concat(F.lit("<div class='hit'><p>"), *told, F.lit("</p><pre>"), *lines, F.lit("</pre></div>\n"))
    short = F.concat(F.lit("- "), said("rule_id"), F.lit(" "), said("artifact_path"), F.lit(":"), F.coalesce(at, F.lit("")), F.lit(" "), said("raw_line"), F.lit("\n"))
    return F.concat(*text, F.lit("\n")), marked, short


def hit_lines(hits: DataFrame) -> DataFrame:
    """Rows of _LINES for numbered hits, in the severity sections and the appendix of both reports; built by expressions alone."""
    text, marked, short = _finding_columns()
    place = F.coalesce(F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), F.col("severity")), F.lit(0)).cast("int")
    x = hits.select(F.col("hit_no").cast("long").alias("no"), place.alias("place"), text.alias("text"), marked.alias("marked"), short.alias("short"))
    section = F.col("place") + F.lit(FIRST_SEVERITY - 1)
    piece = lambda report, section, text: F.struct(F.lit(report).alias("report"), section.cast("int").alias("section"), F.col(text).alias("text"))
    listed = F.array(piece(TEXT, section, "text"), piece(HTML, section, "marked"), piece(TEXT, F.lit(APPENDIX), "short"), piece(HTML, F.lit(APPENDIX), "marked"))
    x = x.select("no", F.explode_outer(listed).alias("p")).filter(F.col("p.section") >= FIRST_SEVERITY)
    return x.select("p.report", "p.section", "no", F.lit("").alias("key"), "p.text")


def _listed(section: int, no: int, key: str, item: str, dash: str = "- ") -> list[tuple]:
    return [(TEXT, section, no, key, f"{dash}{item}\n"), (HTML, section, no, key, f"<li>{html.escape(item)}</li>")]


@dataclass(frozen=True)
class Facts:
    """What the reports say besides hits, artifacts and files: all of it small."""

    artifacts: int
    summary: object
    kbs: list
    negatives: list[str]
    checklist: str


def _frame(facts: Facts, title: str, filled: set[tuple[str, int]]) -> list[tuple]:
    """Headings, ends and fixed sections; ``filled`` are the (report, section) that have rows."""
    s, e, out = facts.summary, html.escape, []
    names = [*fixed.SECTIONS_BEFORE, *[fixed.SECTION_OF_SEVERITY.format(x) for x in fixed.SEVERITIES], *fixed.SECTIONS_AFTER]
    counts = (f"Artifacts reviewed: {facts.artifacts}", f"Hits observed: {s.hit_count}", f"Rules observed: {s.rule_count}")
    kb_lines = [f"KB candidate {r.kb_id}: {r.title}" for r in facts.kbs] or ["None"]
    cautions = fixed.CAUTIONS if s.hit_count else fixed.CAUTIONS_NO_HITS
    lists = {NEGATIVES: (facts.negatives, "- "), KBS: (kb_lines, ""), CAUTIONS: (cautions, "- "), LIMITATIONS: (fixed.CLOSING_LIMITATIONS, "")}
    out.append((TEXT, -1, 0, "", f"{title}\n{'=' * len(title)}\nTerminology: {TERMINOLOGY}\n{PURPOSE}\n"))
    out.append((HTML, -1, 0, "", f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{e(title)}</title><style>{_CSS}</style></head><body><h1>{e(title)}</h1>\n<p><strong>Terminology:</strong> {TERMINOLOGY} {PURPOSE}</p>\n"))
    for k, name in enumerate(names):
        items, dash = lists.get(k, ([], "- "))
        for n, item in enumerate(items):
            out += _listed(k, 1, f"{n:06d}", item, dash)
        there = {report: bool(items) or (report, k) in filled for report in (TEXT, HTML)}
        body = {OVERVIEW: ("\n".join(counts) + "\n", f"<p>{'<br>'.join(counts)}</p>\n"), PRODUCT: (f"{s.product}\n", f"<p>{e(s.product)}</p>\n"), CHECKLIST: (facts.checklist.rstrip() + "\n", f"<pre>{e(facts.checklist)}</pre>\n")}.get(k)
        told = f"\n{name}\n{'-' * len(name)}\n" + (body[0] if body else "" if there[TEXT] or k in (FILES, APPENDIX) else "- None\n")
        out.append((TEXT, k, _HEAD, "", told))
        begin, end = ("", "")
        if k == FILES:
            begin, end = "<table><tr>" + "".join(f"<th>{h}</th>" for h in fixed.FILE_TABLE_HEAD) + "</tr>\n", "</table>\n"
        elif k in (UNDECODED, *lists):
            begin, end = ("<ul>", "</ul>\n") if there[HTML] else ("<p>None</p>\n", "")
        elif not body and not there[HTML]:
            begin = "<p>None</p>\n"
        out.append((HTML, k, _HEAD, "", f"<section><h2>{e(name)}</h2>\n" + (body[1] if body else begin)))
        out.append((HTML, k, _TAIL, "", f"{end}</section>\n"))
    out.append((HTML, len(names), 0, "", "</body></html>\n"))
    return out


def write_reports(coverage: DataFrame, hits: DataFrame, by_file: DataFrame, facts: Facts, text_path: Path, html_path: Path, title: str = TITLE) -> None:
    """Both reports, written by the executors; hits, coverage and files are read once, for all sections of both.

    Every piece of a report is a row with its section and place in it; what comes to the driver is which sections have rows.
    """
    said = hit_lines(hits).unionByName(_lines_of(coverage.select("artifact_ord", "artifact_path", "artifact_family", "review_mode", "limitations", "decoded_successfully"), _said_of_artifact))
    said = cut_lineage(said.unionByName(_lines_of(by_file.select("artifact_path", "artifact_family", "hit_count", "matched_rule_ids", "limitations"), _said_of_file)))
    filled = {(r.report, r.section) for r in said.select("report", "section").distinct().collect()}
    lines = said.unionByName(coverage.sparkSession.createDataFrame(_frame(facts, title, filled), _LINES))
    for report, path in ((TEXT, text_path), (HTML, html_path)):
        write_ordered(lines.filter(F.col("report") == report), ["section", "no", "key"], path)
