"""Reports written line after line on one machine: what the reports that executors write are held against."""

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.sinks import _CSS, PURPOSE, TERMINOLOGY, TITLE, _at, _html_finding, _text_finding, csv_record


def write_csv(df: DataFrame, columns: list[str], path: Path) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(",".join(f'"{c}"' for c in columns) + "\r\n")
        for r in df.select(csv_record(df, columns).alias("r")).toLocalIterator():
            f.write(r.r + "\r\n")


class Facts:
    """What both reports tell, in scan order; hits are streamed anew for each section."""

    def __init__(self, coverage: DataFrame, hits: DataFrame, by_file: DataFrame, summary, kbs, negatives, checklist: str):
        self.coverage, self.hits, self.by_file = coverage.orderBy("artifact_ord"), hits, by_file
        self.summary, self.kbs, self.negatives, self.checklist = summary, kbs, negatives, checklist
        self.not_decoded = [f"{r.artifact_path} ({r.artifact_family}; {r.review_mode}) {r.limitations}" for r in self.coverage.filter("not decoded_successfully and review_mode <> 'stream-scanned'").toLocalIterator()]
        self.limitations = [f"{r.artifact_path}: {r.limitations}" for r in self.coverage.filter("limitations <> ''").toLocalIterator()] + fixed.CLOSING_LIMITATIONS
        self.artifacts = coverage.count()
        self.cautions = fixed.CAUTIONS if summary.hit_count else fixed.CAUTIONS_NO_HITS
        self.kb_lines = [f"KB candidate {r.kb_id}: {r.title}" for r in kbs] or ["None"]

    def hits_of(self, severity: str | None = None):
        found = self.hits if severity is None else self.hits.filter(F.col("severity") == severity)
        return found.orderBy("hit_no").toLocalIterator()


def write_text_report(facts: Facts, path: Path, title: str = TITLE) -> None:
    s = facts.summary
    with open(path, "w", encoding="utf-8") as f:
        put = lambda *lines: f.writelines(line + "\n" for line in lines)
        section = lambda name: put("", name, "-" * len(name))
        listed = lambda items: put(*(f"- {i}" for i in items)) if items else put("- None")
        put(title, "=" * len(title), f"Terminology: {TERMINOLOGY}", PURPOSE)
        section(fixed.SECTIONS_BEFORE[0])
        put(f"Artifacts reviewed: {facts.artifacts}", f"Hits observed: {s.hit_count}", f"Rules observed: {s.rule_count}")
        section(fixed.SECTIONS_BEFORE[1])
        put(s.product)
        section(fixed.SECTIONS_BEFORE[2])
        for r in facts.by_file.toLocalIterator():
            put(f"- {r.artifact_path} ({r.artifact_family}) hits={r.hit_count}")
        section(fixed.SECTIONS_BEFORE[3])
        listed(facts.not_decoded)
        for severity in fixed.SEVERITIES:
            section(fixed.SECTION_OF_SEVERITY.format(severity))
            none = True
            for h in facts.hits_of(severity):
                none = False
                put(_text_finding(h))
            if none:
                put("- None")
        section(fixed.SECTIONS_AFTER[0])
        put(facts.checklist.rstrip())
        section(fixed.SECTIONS_AFTER[1])
        listed(facts.negatives)
        section(fixed.SECTIONS_AFTER[2])
        put(*facts.kb_lines)
        section(fixed.SECTIONS_AFTER[3])
        listed(facts.cautions)
        section(fixed.SECTIONS_AFTER[4])
        for h in facts.hits_of():
            put(f"- {h.rule_id} {h.artifact_path}:{_at(h)} {h.raw_line}")
        section(fixed.SECTIONS_AFTER[5])
        put(*facts.limitations)


def write_html_report(facts: Facts, path: Path, title: str = TITLE) -> None:
    e, s = html.escape, facts.summary
    with open(path, "w", encoding="utf-8") as f:
        put = lambda x: f.write(x + "\n")
        listed = lambda items: "<ul>" + "".join(f"<li>{e(i)}</li>" for i in items) + "</ul>" if items else "<p>None</p>"

        def section(name, parts):
            put(f"<section><h2>{e(name)}</h2>")
            for p in parts:
                put(p)
            put("</section>")

        def findings(severity=None):
            none = True
            for h in facts.hits_of(severity):
                none = False
                yield _html_finding(h)
            if none:
                yield "<p>None</p>"

        def files():
            yield "<table><tr>" + "".join(f"<th>{h}</th>" for h in fixed.FILE_TABLE_HEAD) + "</tr>"
            for r in facts.by_file.toLocalIterator():
                yield "<tr>" + "".join(f"<td>{e(str(x))}</td>" for x in (r.artifact_path, r.artifact_family, r.hit_count, r.matched_rule_ids, r.limitations)) + "</tr>"
            yield "</table>"

        put(f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{e(title)}</title><style>{_CSS}</style></head><body><h1>{e(title)}</h1>")
        put(f"<p><strong>Terminology:</strong> {TERMINOLOGY} {PURPOSE}</p>")
        section(fixed.SECTIONS_BEFORE[0], [f"<p>Artifacts reviewed: {facts.artifacts}<br>Hits observed: {s.hit_count}<br>Rules observed: {s.rule_count}</p>"])
        section(fixed.SECTIONS_BEFORE[1], [f"<p>{e(s.product)}</p>"])
        section(fixed.SECTIONS_BEFORE[2], files())
        section(fixed.SECTIONS_BEFORE[3], [listed(facts.not_decoded)])
        for severity in fixed.SEVERITIES:
            section(fixed.SECTION_OF_SEVERITY.format(severity), findings(severity))
        section(fixed.SECTIONS_AFTER[0], [f"<pre>{e(facts.checklist)}</pre>"])
        section(fixed.SECTIONS_AFTER[1], [listed(facts.negatives)])
        section(fixed.SECTIONS_AFTER[2], [listed(facts.kb_lines)])
        section(fixed.SECTIONS_AFTER[3], [listed(facts.cautions)])
        section(fixed.SECTIONS_AFTER[4], findings())
        section(fixed.SECTIONS_AFTER[5], [listed(facts.limitations)])
        put("</body></html>")
