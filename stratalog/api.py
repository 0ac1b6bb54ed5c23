"""The scan as a library: frames, then reports."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import sinks
from .functions.rules import Pack, built_in
from .lineage import cut_lineage
from .operators import findings as G
from .operators.coverage import binary_part, classified, coverage, text_part
from .operators.scan import add_context, binary_hits, fragments, line_arrays, numbered, row_hits, text_hits
from .schema import COVERAGE_COLUMNS, FILE_FINDING_COLUMNS, HIT_COLUMNS, RULE_FINDING_COLUMNS
from .sources import blocks
from .sources.artifacts import Limits, artifacts
from .sources.decoders import Tools
from .sources.manifest import discover

LOG = logging.getLogger(__name__)
LOG_FILE = "scan.log"


@dataclass(frozen=True)
class Options:
    """``progress`` gets a message now and then; ``limits`` None takes those of ``config``, else the defaults."""

    pack: Pack = field(default_factory=built_in)
    limits: Limits | None = None
    config: str | None = None
    tools: Tools = field(default_factory=Tools)
    exact_chunks: bool = True
    title: str = sinks.TITLE
    progress: Callable[[str], None] | None = None


@dataclass(frozen=True)
class Frames:
    coverage: DataFrame
    hits: DataFrame
    pack: Pack

    @property
    def by_rule(self) -> DataFrame:
        return G.findings_by_rule(self.hits, self.pack)

    @property
    def rule_files(self) -> DataFrame:
        """One row per rule and file, for scans where a rule's files don't fit one cell of ``by_rule``."""
        return G.rule_files(self.hits)

    @property
    def by_file(self) -> DataFrame:
        return G.findings_by_file(self.coverage, self.hits)


@dataclass(frozen=True)
class Result:
    output: Path
    artifact_count: int
    scanned_count: int
    hit_count: int
    severities: dict[str, int]
    warnings: list[str]
    frames: Frames

    def report(self, name: str) -> Path:
        return self.output / name


def limits_from(path: str | None) -> Limits:
    """Limits of a JSON file's ``extraction`` block; no file: the defaults."""
    if path is None:
        return Limits()
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("extraction", {})
    base = Limits()
    return Limits(*(int(found.get(k, getattr(base, k))) for k in ("max_archive_depth", "max_total_extracted_bytes", "max_single_file_bytes")))


def scan_frames(found: DataFrame, pack: Pack, exact_chunks: bool = True) -> Frames:
    """Coverage and numbered hits of artifacts in ARTIFACT_SCHEMA, classified or not; both are stored in the shared folder."""
    found = found if "cls" in found.columns else classified(found)
    covered = cut_lineage(coverage(found, exact_chunks))
    hits = text_hits(line_arrays(text_part(found)), pack).unionByName(binary_hits(fragments(binary_part(found), exact_chunks), pack))
    return Frames(covered, cut_lineage(numbered(hits)), pack)


def scan(spark: SparkSession, inputs: list[str], workspace: str, options: Options | None = None) -> Frames:
    """Frames of the files, folders and archives given."""
    options = options or Options()
    limits = options.limits or limits_from(options.config)
    found = artifacts(spark, discover(inputs), workspace, limits, options.tools)
    return scan_frames(found, options.pack, options.exact_chunks)


def scan_large_logs(spark: SparkSession, path: str, pack: Pack | None = None, block: int = blocks.BLOCK) -> DataFrame:
    """Numbered hits of logs of any size and of all encodings at a path that Spark lists; files are read by blocks."""
    _, lines = blocks.decoded_lines(blocks.index(spark, path, block), blocks.read)
    return numbered(add_context(row_hits(lines, pack or built_in(), None), lines))


def scan_large_binaries(spark: SparkSession, path: str, pack: Pack | None = None, block: int = blocks.BLOCK, exact_chunks: bool = True) -> DataFrame:
    """Numbered hits in the printable runs of binary files of any size at a path that Spark lists."""
    return numbered(binary_hits(blocks.block_fragments(blocks.read(blocks.index(spark, path, block)), exact_chunks), pack or built_in()))


def run_scan(spark: SparkSession, inputs: list[str], output: str, options: Options | None = None) -> Result:
    """Scans the inputs and writes all reports to the folder ``output``."""
    options = options or Options()
    folder = Path(output).expanduser().resolve()
    folder.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(folder / LOG_FILE, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s - %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)

    def say(message: str) -> None:
        LOG.info(message)
        if options.progress:
            options.progress(message)

    try:
        say(f"Created output folder: {folder}")
        frames = scan(spark, inputs, str(folder), options)
        cover, hits = frames.coverage, frames.hits
        by_rule, by_file = cut_lineage(frames.by_rule), cut_lineage(frames.by_file)
        sinks.write_csv(cover, COVERAGE_COLUMNS, folder / sinks.REPORTS[0], ["artifact_ord"])
        say(f"Wrote artifact coverage: {folder / sinks.REPORTS[0]}")
        sinks.write_csv(hits.selectExpr("*", "'' as timestamp"), HIT_COLUMNS, folder / sinks.REPORTS[1], ["hit_no"])
        say(f"Wrote all hits: {folder / sinks.REPORTS[1]}")
        sinks.write_csv(by_rule.withColumn("rank", G.severity_rank(by_rule.severity)), RULE_FINDING_COLUMNS, folder / sinks.REPORTS[2], ["rank", "rule_id"])
        sinks.write_csv(by_file, FILE_FINDING_COLUMNS, folder / sinks.REPORTS[3], ["artifact_path"])
        items = sinks.checklist_text(G.checklist(cover, hits).collect())
        (folder / sinks.REPORTS[4]).write_text(items, encoding="utf-8")
        negatives = [r.message for r in G.negative_searches(cover).collect()]
        summary = G.scan_summary(hits).first()
        facts = sinks.Facts(cover.count(), summary, G.kb_list(hits, frames.pack).collect(), negatives, items)
        sinks.write_reports(cover, hits, by_file, facts, folder / sinks.REPORTS[6], folder / sinks.REPORTS[5], options.title)
        say(f"Wrote triage report: {folder / sinks.REPORTS[5]}")
        counts, severities = G.scanned_count(cover).first(), G.severity_counts(hits).first().asDict()
        told = [r.warning for r in G.warnings(cover).toLocalIterator()]
        return Result(folder, counts.artifact_count, counts.scanned_count, summary.hit_count, {k.removesuffix("_count"): v for k, v in severities.items()}, told, frames)
    finally:
        LOG.removeHandler(handler)
        handler.close()


def new_workspace(base: str) -> Path:
    """A new folder ``scans/<time>`` below ``base``, with -1, -2, ... where that exists."""
    stamp, k = datetime.now().strftime("%Y%m%d-%H%M%S"), 0
    while True:
        folder = Path(base) / "scans" / (f"{stamp}-{k}" if k else stamp)
        try:
            folder.mkdir(parents=True)
            return folder
        except FileExistsError:
            k += 1
