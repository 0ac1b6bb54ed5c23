"""Findings, checklists and searches from coverage and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.rules import Pack
from ..schema import FILE_FINDING_COLUMNS, RULE_FINDING_COLUMNS


def severity_rank(severity: Column) -> Column:
    out = F.lit(99)
    for k, s in enumerate(fixed.SEVERITIES):
        out = F.when(severity == s, k).otherwise(out)
    return out


def location(line_number: Column, byte_offset: Column) -> Column:
    return F.coalesce(line_number.cast("string"), byte_offset.cast("string"), F.lit(""))


def _looked_up(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(r.rule_id, r.missing_evidence, r.false_positive_cautions) for r in pack.rules]
    return spark.createDataFrame(rows, "rule_id string, missing_evidence string, false_positive_cautions string")


def first_hit(order: list[str]) -> Column:
    return F.struct(*order)


def rule_files(hits: DataFrame) -> DataFrame:
    """(rule_id, artifact_path, hit_count): one row per rule and file, for corpora where a rule's files don't fit one cell of a report."""
    return hits.groupBy("rule_id", "artifact_path").agg(F.count("*").alias("hit_count"))


_SAID = ["product", "issue_category", "component", "severity", "kb_candidate_ids"]


def rule_partials(hits: DataFrame, order=("artifact_ord", "chunk_no", "kind_ord", "pos", "rule_ord")) -> DataFrame:
    """(rule_id, artifact_path, n, first): hits of a rule in a file and what the first of them says. Unions of these merge by ``merged_by_rule``."""
    return hits.groupBy("rule_id", "artifact_path").agg(F.count("*").alias("n"), F.min(F.struct(*order, *_SAID, location(F.col("line_number"), F.col("byte_offset")).alias("at"))).alias("first"))


def merged_by_rule(partials: DataFrame, pack: Pack) -> DataFrame:
    """Findings by rule from the partials of any number of scans."""
    one = partials.groupBy("rule_id", "artifact_path").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    by = one.groupBy("rule_id").agg(F.sum("n").alias("hit_count"), F.array_join(F.sort_array(F.collect_list("artifact_path")), ";").alias("artifacts_hit"), F.min(F.struct("first", "artifact_path")).alias("f"))
    x = by.select("rule_id", "hit_count", "artifacts_hit", *[F.col(f"f.first.{c}").alias(c) for c in _SAID], F.col("f.artifact_path").alias("first_seen_file"), F.col("f.first.at").alias("first_seen_line"))
    x = x.join(F.broadcast(_looked_up(partials.sparkSession, pack)), "rule_id", "left")
    known = F.col("missing_evidence").isNotNull()
    x = x.withColumn("required_evidence_status", F.when(known & (F.col("rule_id") != fixed.GENERIC_RULE), fixed.STATUS_RULE).otherwise(fixed.STATUS_GENERIC))
    x = x.withColumns({"missing_evidence": F.coalesce("missing_evidence", F.lit(fixed.STATUS_GENERIC)), "false_positive_cautions": F.coalesce("false_positive_cautions", F.lit(fixed.CAUTION_GENERIC))})
    return x.select(*RULE_FINDING_COLUMNS).orderBy(severity_rank(F.col("severity")), "rule_id")


def findings_by_rule(hits: DataFrame, pack: Pack) -> DataFrame:
    """One row per rule with hits, most severe first: counts, distinct files, and what its first hit in scan order says.

    Distinct files are found by a grouping of (rule, file) before they are gathered, so a frequent rule gathers paths
    and not hits. The report names all of a rule's files in one cell; ``rule_files`` has them as rows.
    """
    return merged_by_rule(rule_partials(hits), pack)


def last_rows(coverage: DataFrame) -> DataFrame:
    """Of rows with one path the last in scan order."""
    rest = [c for c in coverage.columns if c != "artifact_path"]
    x = coverage.groupBy("artifact_path").agg(F.max_by(F.struct(*rest), F.col("artifact_ord")).alias("r"))
    return x.select("artifact_path", "r.*")


def file_partials(hits: DataFrame) -> DataFrame:
    """(artifact_path, rule_id, severity, n): hits of a file by rule. Unions of these merge by ``merged_by_file``."""
    return hits.groupBy("artifact_path", "rule_id", "severity").agg(F.count("*").alias("n"))


def merged_by_file(coverage: DataFrame, partials: DataFrame) -> DataFrame:
    """Findings by file from the coverage and the partials of any number of scans."""
    low = F.lower("severity")
    count = lambda s: F.sum(F.when(low == s, F.col("n")).otherwise(0)).alias(f"{s}_count")
    by = partials.groupBy("artifact_path").agg(F.sum("n").alias("hit_count"), *[count(s.lower()) for s in fixed.SEVERITIES], F.array_join(F.sort_array(F.collect_set("rule_id")), ";").alias("matched_rule_ids"))
    x = last_rows(coverage).join(by, "artifact_path", "left").na.fill(0, [c for c in FILE_FINDING_COLUMNS if c.endswith("_count")]).na.fill("", ["matched_rule_ids"])
    return x.select(*FILE_FINDING_COLUMNS).orderBy("artifact_path")


def findings_by_file(coverage: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per path, by path: hits by severity and distinct rules; files without hits too."""
    return merged_by_file(coverage, file_partials(hits))


def severity_counts(hits: DataFrame) -> DataFrame:
    """One row: hits by severity, unknown ones as info."""
    low = F.lower("severity")
    known = [s.lower() for s in fixed.SEVERITIES]
    cols = [F.count(F.when((low == s) | ((~low.isin(*known) | low.isNull()) if s == "info" else F.lit(False)), 1)).alias(f"{s}_count") for s in known]
    return hits.agg(*cols)


def scanned_count(coverage: DataFrame) -> DataFrame:
    scanned = F.col("review_mode").isin("stream-scanned", "binary-string-scanned") | (F.col("lines_or_rows_scanned") > 0) | (F.col("bytes_scanned") > 0)
    return coverage.agg(F.count("*").alias("artifact_count"), F.count(F.when(scanned, 1)).alias("scanned_count"))


def scan_summary(hits: DataFrame) -> DataFrame:
    """One row: hit_count, rule_count, product."""
    return hits.agg(F.count("*").alias("hit_count"), F.count_distinct("rule_id").alias("rule_count"), F.when(F.coalesce(F.bool_or(F.col("product") == fixed.PRODUCT), F.lit(False)), fixed.PRODUCT).otherwise("Unknown").alias("product"))


def kb_list(hits: DataFrame, pack: Pack) -> DataFrame:
    """(kb_id, title) of the distinct candidates of all hits, by id as text."""
    titles = hits.sparkSession.createDataFrame(list(pack.kb_titles.items()) or [("", "")], "kb_id string, title string")
    ids = hits.select("kb_candidate_ids").distinct().select(F.explode(F.split("kb_candidate_ids", ";")).alias("c")).filter("c <> ''")
    ids = ids.select(F.regexp_replace("c", "^KB candidate ", "").alias("kb_id")).distinct()
    return ids.join(F.broadcast(titles), "kb_id", "left").select("kb_id", F.coalesce("title", F.lit("Unknown title")).alias("title")).orderBy("kb_id")


def warnings(coverage: DataFrame) -> DataFrame:
    """(warning, first_ord): distinct warnings in the order in which they first occur."""
    status = F.col("decoder_status").isin("archive-loop-detected", "scan-failed", "skipped-by-policy", "skipped-symlink-input", "unreadable", "unsafe-archive-path-refused")
    said = F.when(F.col("limitations") != "", F.concat_ws(": ", "artifact_path", "limitations")).when(status, F.concat_ws(": ", "artifact_path", "decoder_status"))
    return coverage.select("artifact_ord", said.alias("warning")).filter("warning is not null").groupBy("warning").agg(F.min("artifact_ord").alias("first_ord")).orderBy("first_ord", "warning")


def scanned_families(coverage: DataFrame) -> DataFrame:
    """(family, flags) of scanned artifacts."""
    return coverage.filter(F.col("review_mode").isin("stream-scanned", "binary-string-scanned")).groupBy("artifact_family").agg(F.bit_or("flags").alias("flags"))


def negative_searches(coverage: DataFrame, specs=fixed.NEGATIVE_SEARCHES) -> DataFrame:
    """(spec_ord, message): searches that found nothing although a relevant artifact was scanned.

    A semi join keeps the specs with a scanned family, an anti join drops those whose words were found in one.
    """
    spark = coverage.sparkSession
    table = spark.createDataFrame([(k, m, 1 << k if needles else 0, target) for k, (m, _, needles, target) in enumerate(specs)], "spec_ord int, message string, bit int, target string")
    wanted = spark.createDataFrame([(k, f) for k, (_, families, _, _) in enumerate(specs) for f in families], "spec_ord int, artifact_family string")
    seen = scanned_families(coverage)
    relevant = seen.join(F.broadcast(wanted), "artifact_family")
    found = relevant.join(F.broadcast(table.select("spec_ord", "bit")), "spec_ord").filter(F.col("flags").bitwiseAND(F.col("bit")) != 0).select("spec_ord")
    there = seen.join(F.broadcast(table.select("spec_ord", F.col("target").alias("artifact_family"))), "artifact_family").select("spec_ord")
    return table.join(relevant.select("spec_ord").distinct(), "spec_ord", "left_semi").join(found.unionByName(there).distinct(), "spec_ord", "left_anti").select("spec_ord", "message").orderBy("spec_ord")


def available_evidence(coverage: DataFrame, hits: DataFrame, tokens=fixed.EVIDENCE_TOKENS) -> DataFrame:
    """(token): families of all artifacts, and the tokens that occur in a path, line or match. Each table is read once, for all tokens."""
    has = lambda cols: [F.bool_or(F.lower(F.concat_ws("\n", *cols)).contains(t)).alias(f"t{k}") for k, t in enumerate(tokens)]
    flags = coverage.agg(*has(["artifact_path"])).unionByName(hits.agg(*has(["raw_line", "matched_text"])))
    listed = F.filter(F.array(*[F.when(F.col(f"t{k}"), F.lit(t)) for k, t in enumerate(tokens)]), lambda t: t.isNotNull())
    return flags.select(F.explode(listed).alias("token")).unionByName(coverage.select(F.lower("artifact_family").alias("token"))).distinct()


def checklist(coverage: DataFrame, hits: DataFrame, items=fixed.CHECKLIST) -> DataFrame:
    """(item_ord, family, item, observed) of the missing-evidence checklist; the evidence is one bounded array, so nothing is crossed."""
    spark = coverage.sparkSession
    rows = [(f, i) for f, its in items.items() for i in its]
    table = spark.createDataFrame([(k, f, i, _alias(i)) for k, (f, i) in enumerate(rows)], "item_ord int, family string, item string, aliases array<string>")
    evidence = [r.token for r in available_evidence(coverage, hits).collect()]  # at most the families and the tokens
    known = F.array(*map(F.lit, evidence)) if evidence else F.array().cast("array<string>")
    low = F.lower("item")
    observed = F.when(F.size("aliases") > 0, F.arrays_overlap("aliases", known)).otherwise(F.exists(known, lambda t: F.contains(low, t) | F.contains(t, low)))
    return table.select("item_ord", "family", "item", F.coalesce(observed, F.lit(False)).alias("observed")).orderBy("item_ord")


def _alias(item: str) -> list[str]:
    return next((a for k, a in fixed.EVIDENCE_ALIASES.items() if k in item.lower()), [])


def duplicates(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows with digest (SHA-256 of ``key``) and copy_no, from 1 in the given order."""
    return df.withColumn("digest", F.sha2(key.cast("binary"), 256)).withColumn("copy_no", F.row_number().over(Window.partitionBy("digest").orderBy(*order)))


def lineage(coverage: DataFrame) -> DataFrame:
    """(artifact_path, extracted_from, parent_family): children with what they came out of."""
    parents = last_rows(coverage.filter("identified_by not like 'policy:%' and identified_by not like 'hash:%'")).select(F.col("artifact_path").alias("extracted_from"), F.col("artifact_family").alias("parent_family"))
    return coverage.filter("extracted_from <> ''").select("artifact_path", "extracted_from").join(parents, "extracted_from", "left")
